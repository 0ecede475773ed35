"""Overlapping and gapped time intervals per entity.

Starts and ends are ranked independently within their entity.  A gap exists
where the start of rank k+1 exceeds the end of rank k, that is, where as many
starts as ends lie up to an end; the boundaries beside the gaps, taken in
pairs, give the continuous periods.

Ranks are running counts over blocks of time (``functions.prefix``): an entity
with a third of all rows is spread over its blocks, and equal boundaries are
counted by partial aggregation before anything is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.paths import same_path
from logweave.functions.prefix import running_sums
from logweave.session import ensure_checkpoint_dir


def periods_and_gaps(intervals: DataFrame, key: str = "entity", width: int = 6 * 3_600_000_000) -> DataFrame:
    """Continuous periods and the gaps between them: (key, kind, start_us, end_us).

    ``intervals``: key, start_us, end_us.  Intervals with a null, or that end
    before they start, are left out; repeated ones change nothing; touching
    ones merge; an entity without intervals has no row, an interval of no
    length is a period.  Extra columns are not read.  ``width`` is the length
    of the blocks of time that are sorted on their own.
    """
    ensure_checkpoint_dir(intervals.sparkSession)
    clean = intervals.select(F.col(key).alias("entity"), "start_us", "end_us").where("entity is not null and start_us is not null and end_us is not null and start_us <= end_us")
    side = lambda at, start: F.struct(F.col(at).alias("at"), F.lit(start).alias("start"), F.lit(1 - start).alias("end"))
    marks = clean.select("entity", F.explode(F.array(side("start_us", 1), side("end_us", 0))).alias("m"))
    counted = marks.groupBy("entity", F.col("m.at").alias("at")).agg(F.sum("m.start").alias("starts"), F.sum("m.end").alias("ends")).checkpoint()  # read by both parts of the running sums
    ranks = running_sums(counted, ["entity"], "at", {"start_rank": "starts", "end_rank": "ends"}, width)
    opens = (F.col("starts") > 0) & (F.col("start_rank") - F.col("starts") == F.col("end_rank") - F.col("ends"))
    closes = (F.col("ends") > 0) & (F.col("start_rank") == F.col("end_rank"))
    # few rows, read by both halves of the next running sum
    boundaries = ranks.select("entity", "at", opens.cast("int").alias("opens"), closes.alias("closes")).where("opens = 1 or closes").checkpoint()
    numbered = running_sums(boundaries, ["entity"], "at", {"no": "opens"}, width)
    roles = F.array(
        F.when(F.col("opens") == 1, F.struct(F.col("no").alias("no"), F.lit("start").alias("role"))),
        F.when(F.col("closes"), F.struct(F.col("no").alias("no"), F.lit("end").alias("role"))),
        F.when((F.col("opens") == 1) & (F.col("no") > 1), F.struct((F.col("no") - 1).alias("no"), F.lit("next").alias("role"))),
    )
    placed = numbered.select("entity", "at", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"))
    value = lambda role: F.max(F.when(F.col("r.role") == role, F.col("at")))
    paired = placed.groupBy("entity", F.col("r.no").alias("no")).agg(value("start").alias("start_us"), value("end").alias("end_us"), value("next").alias("next_us"))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("start_us"), F.col(b).alias("end_us"))
    rows = F.array(row("period", "start_us", "end_us"), F.when(F.col("next_us").isNotNull(), row("gap", "end_us", "next_us")))
    return paired.select("entity", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(F.col("entity").alias(key), "r.kind", "r.start_us", "r.end_us")


def found_periods(chunks: DataFrame) -> DataFrame:
    """Periods and gaps of every source_path from its chunks with time and both bounds."""
    rows = chunks.where("has_time").select(same_path(F.col("source_path")).alias("source_path"), F.unix_micros(F.col("time_start")).alias("start_us"), F.unix_micros(F.col("time_end")).alias("end_us"))
    return periods_and_gaps(rows, "source_path")
