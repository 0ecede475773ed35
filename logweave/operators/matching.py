"""Matching incidents, log matches and ticket rows by dates, lines and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.metrics import containments

DAY_US = 86_400_000_000


def utc_second(text: Column) -> Column:
    """ISO time with or without zone as a UTC second; null where it is none."""
    return F.date_trunc("second", F.try_to_timestamp(F.trim(text)))


def normal_text(text: Column) -> Column:
    """Lower case, blanks collapsed and stripped."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def plain_line(line: Column) -> Column:
    """Without a leading time mark and then one leading ``-``, ``:`` or ``|``."""
    bare = F.regexp_replace(F.trim(line), r"^(?i)<time>\s*", "")
    return F.trim(F.regexp_replace(bare, r"^\s*[-:|]\s*", ""))


def line_variants(line: Column, least: int = 4) -> Column:
    """The line as it is and without its time mark, normalised, each at least ``least`` characters long."""
    both = F.array_distinct(F.array(normal_text(line), normal_text(plain_line(line))))
    return F.filter(both, lambda x: F.length(x) >= least)


def line_shape(line: Column) -> Column:
    """A line without its numbers, for comparing what was written by one program."""
    return F.regexp_replace(line, r"0x[0-9a-f]+|[0-9]+(\.[0-9]+)?", "#")


def score_rows(lines: DataFrame, rows: DataFrame, shapes: bool = False) -> DataFrame:
    """Ticket rows that quote source lines of their date: result_id, ticket_id, sheet_id, row_no, score, matched_cells.

    ``lines``: result_id, matched_date, line; ``rows``: ticket_id, sheet_id,
    row_no, matched_dates, cells.  A row quotes a line if a variant of it is
    part of a cell, or of the cells joined by `` | ``.  The score counts the
    distinct lines, matched_cells those of each column.  With ``shapes`` lines
    and cells are compared without their numbers.  Dates meet in an equi-join
    and lines by their rarest runs of words, not in pairs.
    """
    seen = line_shape if shapes else lambda text: text
    key = F.struct("ticket_id", "sheet_id", "row_no")
    filled = F.filter("cells", lambda c: c["cell_value"].isNotNull() & (normal_text(c["cell_value"]) != ""))
    cells = F.transform(filled, lambda c: F.struct(c["col_letter"].alias("col"), seen(normal_text(c["cell_value"])).alias("value")))
    tidy = rows.select(key.alias("id"), "matched_dates", cells.alias("cells"))
    bodies = tidy.select("id", F.explode(F.array_distinct("matched_dates")).alias("matched_date"), "cells").dropDuplicates(["id", "matched_date"])
    texts = bodies.select("id", "matched_date", F.array_join(F.transform("cells", lambda c: c["value"]), " | ").alias("text"))
    variants = lines.distinct().select("result_id", "matched_date", F.col("line").alias("raw"), F.explode(line_variants(F.col("line"))).alias("line")).withColumn("line", seen(F.col("line"))).distinct()
    found = containments(texts, variants.select("matched_date", "line"), also=("matched_date",))
    quoted = found.join(variants, ["matched_date", "line"]).join(bodies, ["id", "matched_date"])
    hits = quoted.select("result_id", "id", "raw", F.transform(F.filter("cells", lambda c: F.contains(c["value"], F.col("line"))), lambda c: c["col"]).alias("cols"))
    per_line = hits.groupBy("result_id", "id", "raw").agg(F.array_distinct(F.flatten(F.collect_list("cols"))).alias("cols"))
    scores = per_line.groupBy("result_id", "id").agg(F.count("*").alias("score"))
    columns = per_line.select("result_id", "id", F.explode("cols").alias("col")).groupBy("result_id", "id", "col").agg(F.count("*").alias("n")).groupBy("result_id", "id")
    counted = columns.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "n")))).alias("matched_cells"))
    none = F.create_map().cast("map<string,bigint>")
    return scores.join(counted, ["result_id", "id"], "left").select("result_id", "id.*", "score", F.coalesce("matched_cells", none).alias("matched_cells"))


def window_join(points: DataFrame, records: DataFrame, before_us: int, after_us: int, key: str = "unit") -> DataFrame:
    """Records whose time lies in the window around a point of the same key, both ends included.

    ``points``: key, point_id, at_us; ``records``: key, record_id, at_us.
    Windows are exploded to the days they touch, so that the range join is
    an equi-join on key and day with the range as residual.
    """
    day = lambda c: F.floor(c / F.lit(DAY_US))
    spans = points.select(key, "point_id", (F.col("at_us") - before_us).alias("first_us"), (F.col("at_us") + after_us).alias("last_us"))
    spans = spans.withColumn("day", F.explode(F.sequence(day(F.col("first_us")), day(F.col("last_us")))))
    dated = records.select(key, "record_id", "at_us", day(F.col("at_us")).alias("day"))
    return spans.join(dated, [key, "day"]).where(F.col("at_us").between(F.col("first_us"), F.col("last_us"))).select("point_id", "record_id", "at_us")


def window_counts(points: DataFrame, records: DataFrame, before_us: int, after_us: int, key: str = "unit") -> DataFrame:
    """Number of records in the window of each point, without listing them.

    Whole days inside a window are counted from daily totals; only the two
    days at its ends are compared record by record, as running counts within
    a day.  A point without records has 0.
    """
    day = lambda c: F.floor(c / F.lit(DAY_US))
    times = records.where(F.col("at_us").isNotNull() & F.col(key).isNotNull()).groupBy(key, "at_us").agg(F.count("*").alias("n")).withColumn("day", day(F.col("at_us")))
    totals = times.groupBy(key, "day").agg(F.sum("n").alias("n_day"))
    upto = W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    ends = points.where(F.col("at_us").isNotNull() & F.col(key).isNotNull()).select(
        key, "point_id", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (F.col("at_us") - before_us - 1).alias("edge")), F.struct(F.lit(1).alias("sign"), (F.col("at_us") + after_us).alias("edge")))).alias("e")
    )
    edges = ends.select(key, "point_id", "e.sign", "e.edge", day(F.col("e.edge")).alias("day"))
    # running counts at the edges: records and edges of one key and day in one order, records first
    marks = times.select(key, "day", F.col("at_us").alias("place"), F.lit(0).alias("kind"), "n", F.lit(None).cast("bigint").alias("point_id"), F.lit(0).alias("sign"))
    asked = edges.select(key, "day", F.col("edge").alias("place"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("n"), "point_id", "sign")
    both = marks.unionByName(asked)
    running = F.sum("n").over(W.partitionBy(key, "day").orderBy("place", "kind").rowsBetween(W.unboundedPreceding, 0))
    within = both.withColumn("upto", running).where("kind = 1")
    # totals of all earlier days, also of days without records of their own
    days = within.select(key, "day").distinct().withColumn("n_day", F.lit(0).cast("bigint")).unionByName(totals)
    earlier = days.groupBy(key, "day").agg(F.sum("n_day").alias("n_day"))
    earlier = earlier.select(key, "day", F.coalesce(F.sum("n_day").over(upto), F.lit(0)).alias("n_before"))
    counted = within.join(earlier, [key, "day"]).groupBy("point_id").agg(F.sum(F.col("sign") * (F.col("upto") + F.col("n_before"))).cast("bigint").alias("n"))
    return points.select("point_id").join(counted, "point_id", "left").select("point_id", F.coalesce("n", F.lit(0)).alias("n"))


def best_rows(scored: DataFrame, keys: list[str], keep_ties: bool = True) -> DataFrame:
    """Rows of the highest score per key; with ties, or the first by sheet and row."""
    place = F.rank().over(W.partitionBy(*keys).orderBy(F.desc("score"))) if keep_ties else F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "sheet_id", "row_no", "ticket_id"))
    return scored.withColumn("place", place).where("place = 1").drop("place")
