"""Matching records by nearest time: tick expansion.

Time is cut into ticks.  Of every tick the first and the last right record
are exploded to all ticks within the tolerance, and per entity and tick only
the nearest ones before and after it are kept, besides the records inside.
Left records find their candidates by an equi-join on entity and tick.

A tick with many records is cut into finer ticks, and those again, so that no
list of candidates grows with the data: per finer tick the nearest record
before and after it is handed on, too.  An entity with a third of all rows is
spread over its ticks, and equal times are reduced to one record first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.joins import small
from logweave.functions.paths import path_unit, unit_key
from logweave.operators.timestamps import ticket_unit
from logweave.session import ensure_checkpoint_dir

TOLERANCE_US = 2_700 * 1_000_000
TICK_US = 900 * 1_000_000
#: A tick of more records is cut into so many finer ones.
DENSE, PARTS = 256, 4_096

def _record() -> Column:
    return F.struct("at_us", "right_id")


def _summaries(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per tick the number of its records, the first and the last."""
    return records.groupBy(*keys).agg(F.count("*").alias("n"), F.min(_record()).alias("first"), F.max(_record()).alias("last"))


def _inside(records: DataFrame, ticks: DataFrame, keys: list[str]) -> DataFrame:
    """The records of every tick that holds at most ``DENSE`` of them."""
    return records.join(ticks.where(F.col("n") <= DENSE).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.collect_list(_record()).alias("inside"))


def _combined(keys: list[str], reach: DataFrame, inside: DataFrame, dense: DataFrame) -> DataFrame:
    """One row per tick: before, after, inside (null if none), dense."""
    none = lambda like: F.lit(None).cast(reach.schema[like].dataType)
    listed = inside.schema["inside"].dataType
    rows = reach.select(*keys, "before", "after", F.lit(None).cast(listed).alias("inside"), F.lit(False).alias("dense"))
    rows = rows.unionByName(inside.select(*keys, none("before").alias("before"), none("after").alias("after"), "inside", F.lit(False).alias("dense")))
    rows = rows.unionByName(dense.select(*keys, none("before").alias("before"), none("after").alias("after"), F.lit(None).cast(listed).alias("inside"), F.lit(True).alias("dense")))
    return rows.groupBy(*keys).agg(F.max("before").alias("before"), F.min("after").alias("after"), F.first("inside", ignorenulls=True).alias("inside"), F.max("dense").alias("dense"))


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int = TOLERANCE_US, tick_us: int = TICK_US) -> DataFrame:
    """Per left record the nearest right record of its entity: (left_id, right_id).

    ``left``: entity, at_us, left_id; ``right``: entity, at_us, right_id.  On a
    tie the earlier right record counts, then the smaller right_id.  Rows with
    a null entity or time match nothing; a left record without a match within
    the tolerance (inclusive) has no row; repeated left records are matched
    each, repeated right records count once.
    """
    ensure_checkpoint_dir(right.sparkSession)
    tick = lambda c: F.floor(c / F.lit(tick_us)).cast("bigint")
    keys = ["entity", "tick"]
    records = right.where("entity is not null and at_us is not null").groupBy("entity", "at_us").agg(F.min("right_id").alias("right_id")).withColumn("tick", tick(F.col("at_us"))).checkpoint()
    ticks = _summaries(records, keys).checkpoint()
    # the last record of a tick reaches the ticks behind it, the first one those before it
    forward = F.sequence(F.col("tick"), tick(F.col("last.at_us") + tolerance_us))
    backward = F.sequence(tick(F.col("first.at_us") - tolerance_us), F.col("tick"))
    nowhere = F.lit(None).cast(ticks.schema["first"].dataType)
    behind = ticks.select("entity", F.explode(forward).alias("to"), F.col("tick"), F.col("last").alias("before"), nowhere.alias("after"))
    ahead = ticks.select("entity", F.explode(backward).alias("to"), F.col("tick"), nowhere.alias("before"), F.col("first").alias("after"))
    reach = behind.unionByName(ahead).where("to <> tick").select("entity", F.col("to").alias("tick"), "before", "after")
    dense = ticks.where(F.col("n") > DENSE)
    kept = _combined(keys, reach, _inside(records, ticks, keys), dense)
    asked = left.where("entity is not null and at_us is not null").select("entity", "at_us", "left_id", tick(F.col("at_us")).alias("tick"))
    found = asked.join(kept, keys)
    answers = [found]
    # finer ticks where there are many records
    start, width = F.col("tick") * tick_us, tick_us
    while width > 1 and dense.limit(1).count():
        name, finer = f"part_{len(answers)}", -(-width // PARTS)
        within = lambda at, start=start, finer=finer: F.floor((at - start) / F.lit(finer)).cast("bigint")
        records = records.join(dense.select(*keys), keys, "left_semi").withColumn(name, within(F.col("at_us")))
        outer, keys = keys, [*keys, name]
        ticks = _summaries(records, keys).checkpoint()
        # every finer tick of a dense one has a row, whether it holds records or not
        grid = dense.select(*outer, F.explode(F.sequence(F.lit(0), F.lit(-(-width // finer) - 1).cast("bigint"))).alias(name)).join(ticks, keys, "left")
        order = W.partitionBy(*outer).orderBy(name)
        before = F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
        after = F.first("first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
        dense = ticks.where(F.col("n") > DENSE)
        kept = _combined(keys, grid.select(*keys, before.alias("before"), after.alias("after")), _inside(records, ticks, keys), dense)
        going_on = answers[-1].where("dense").withColumn(name, within(F.col("at_us"))).drop("dense", "inside")
        # what lies outside of the coarser tick stays in reach where nothing nearer does
        joined = going_on.withColumnsRenamed({"before": "far_before", "after": "far_after"}).join(kept, keys)
        answers.append(joined.withColumns({"before": F.coalesce("before", "far_before"), "after": F.coalesce("after", "far_after")}).drop("far_before", "far_after"))
        start, width = start + F.col(name) * finer, finer
    matched = None
    for level, answer in enumerate(answers):
        sparse = answer if level == len(answers) - 1 else answer.where("not dense")
        candidates = F.filter(F.concat(F.array("before", "after"), F.coalesce("inside", F.slice(F.array("before"), 1, 0))), lambda r: r.isNotNull())
        distances = F.transform(candidates, lambda r: F.struct(F.abs(r["at_us"] - F.col("at_us")).alias("distance"), r["at_us"].alias("at_us"), r["right_id"].alias("right_id")))
        best = sparse.select("left_id", F.array_min(distances).alias("best")).where(F.col("best.distance") <= tolerance_us).select("left_id", F.col("best.right_id").alias("right_id"))
        matched = best if matched is None else matched.unionByName(best)
    return matched


def found_matches(incidents: DataFrame, tickets: DataFrame, results: DataFrame, units: DataFrame) -> DataFrame:
    """The nearest match_results entry of the unit of each incident: (incident_id, result_id)."""
    known = units.select(unit_key(F.col("unit_code")).alias("entity")).where("entity is not null").distinct()
    of_ticket = tickets.select("ticket_id", ticket_unit(F.col("headers"), F.col("row_values")).alias("entity")).where("entity is not null").groupBy("ticket_id").agg(F.min("entity").alias("entity"))
    micros = lambda c: F.unix_micros(F.try_to_timestamp(F.trim(c)))
    left = (
        incidents.where("mapped_date is not null")
        .select("ticket_id", "incident_id", micros(F.col("mapped_date")).alias("at_us"))
        .join(of_ticket, "ticket_id")
        .join(small(known), "entity", "left_semi")
        .select("entity", "at_us", F.col("incident_id").alias("left_id"))
    )
    path = F.filter(F.transform("match_list", lambda m: m["source_path"]), lambda p: p.isNotNull())
    right = results.select(
        unit_key(path_unit(F.try_element_at(path, F.lit(1)))).alias("entity"), F.coalesce(micros(F.col("source_ts")), micros(F.col("normalized_timestamp"))).alias("at_us"), F.col("result_id").alias("right_id")
    )
    return nearest(left, right).select(F.col("left_id").alias("incident_id"), F.col("right_id").alias("result_id"))
