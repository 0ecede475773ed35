"""The evidence build: per incident the records in its window, deduplicated, split and packed into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.prefix import ranked, running_sum
from logweave.operators.dedup import fixed_pieces, packed_chunks
from logweave.operators.matching import DAY_US

#: Deduplicated records of one source and incident that are packed together.
BLOCK = 5_000


def window_records(incidents: DataFrame, records: DataFrame, before_us: int = DAY_US, after_us: int = DAY_US) -> DataFrame:
    """Records (unit, source_path, ts_us, text, cnt) of the unit of each incident (unit, incident_id, at_us) inside its window.

    Incidents are exploded to the days of their window; the join is on unit
    and day with the range as residual.
    """
    day = lambda c: F.floor(c / F.lit(DAY_US))
    spans = incidents.where("unit is not null and at_us is not null").select("unit", "incident_id", (F.col("at_us") - before_us).alias("first_us"), (F.col("at_us") + after_us).alias("last_us"))
    spans = spans.withColumn("day", F.explode(F.sequence(day(F.col("first_us")), day(F.col("last_us")))))
    dated = records.where("ts_us is not null").withColumn("day", day(F.col("ts_us")))
    return spans.join(dated, ["unit", "day"]).where(F.col("ts_us").between(F.col("first_us"), F.col("last_us"))).select("incident_id", "source_path", "ts_us", "text", "cnt")


def deduplicated(found: DataFrame) -> DataFrame:
    """One row per incident, source and text: first and last time, number of events."""
    return found.groupBy("incident_id", "source_path", "text").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum(F.coalesce("cnt", F.lit(1))).alias("cnt"))


def packed(lines: DataFrame, max_chars: int = 3000, block: int = BLOCK) -> DataFrame:
    """Chunks of deduplicated lines: incident_id, source_path, chunk_id from 0, n_records, n_chars, content.

    Lines stand in the order of their last time.  A text longer than a chunk
    is cut into pieces first.  Packing is greedy within blocks of ``block``
    records, so that a source of any size is packed in many tasks; chunks are
    numbered over all blocks.  No chunk exceeds ``max_chars``.
    """
    keys = ["incident_id", "source_path"]
    room = max_chars - 40  # the times of a record count too
    cut = lines.select(*keys, "first_us", "last_us", "cnt", F.posexplode(fixed_pieces(F.coalesce("text", F.lit("")), room)).alias("piece_no", "text"))
    placed = ranked(cut.withColumn("hash", F.md5("text")), keys, "last_us", DAY_US // 24, ("hash", "piece_no"))
    record = F.struct("rank", "first_us", "last_us", "cnt", "text")
    blocks = placed.groupBy(*keys, F.floor((F.col("rank") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    sizes = F.transform("records", lambda r: F.length(r["text"]) + F.when(r["cnt"] > 1, 40).otherwise(19))
    marked = blocks.withColumn("marks", packed_chunks(sizes, max_chars))
    numbered = running_sum(marked.withColumn("n_chunks", F.array_max("marks") + 1), keys, "block", "n_chunks", 1000, name="upto")
    each = numbered.select(*keys, (F.col("upto") - F.col("n_chunks")).alias("base"), F.explode(F.arrays_zip("records", "marks")).alias("x"))
    chunk = (F.col("base") + F.col("x.marks")).cast("int").alias("chunk_id")
    grouped = each.select(*keys, chunk, "x.records").groupBy(*keys, "chunk_id").agg(F.array_sort(F.collect_list("records")).alias("content"))
    chars = F.aggregate(F.transform("content", lambda r: F.length(r["text"])), F.lit(0), lambda a, b: a + b)
    content = F.transform("content", lambda r: F.struct(F.timestamp_micros(r["first_us"]).alias("ts_start"), F.timestamp_micros(r["last_us"]).alias("ts_end"), r["cnt"].alias("cnt"), r["text"].alias("text")))
    return grouped.select(*keys, "chunk_id", F.size("content").alias("n_records"), chars.alias("n_chars"), content.alias("content"))


def build(incidents: DataFrame, records: DataFrame, max_chars: int = 3000) -> DataFrame:
    return packed(deduplicated(window_records(incidents, records)), max_chars)
