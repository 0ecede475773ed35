"""Fixed-width binary event files: an 11-byte header, then records of 32 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout of a file.
HEADER, RECORD = 11, 32


def _unsigned(data: Column, position: int, size: int, little: bool) -> Column:
    """An unsigned number at a byte position from 0."""
    part = F.hex(F.substring(data, position + 1, size))
    if little:
        part = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(part, 16, 10).cast("bigint")


def _word(data: Column, position: int) -> Column:
    """A little-endian word as ``0x`` and eight digits."""
    part = F.hex(F.substring(data, position + 1, 4))
    return F.concat(F.lit("0x"), F.lower(F.concat(*[F.substring(part, 2 * i + 1, 2) for i in reversed(range(4))])))


def decode(files: DataFrame) -> DataFrame:
    """Events of files (path, content): path, rec_no, ts, event_id, module, flags, subcode, arg1..arg3.

    Records with the second 0 or all ones are left out, a cut record at the
    end too; a file without records gives none.
    """
    count = F.greatest(F.floor((F.length("content") - HEADER) / RECORD), F.lit(0)).cast("int")
    numbered = files.withColumn("n", count).where("n > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("rec_no"))
    cut = numbered.select("path", "rec_no", F.substr("content", HEADER + 1 + F.col("rec_no") * RECORD, F.lit(RECORD)).alias("r"))
    r = F.col("r")
    seconds = _unsigned(r, 0, 4, little=False)
    out = cut.select(
        "path", "rec_no", seconds.alias("s"), _unsigned(r, 5, 2, True).alias("event_id"), _unsigned(r, 7, 2, True).alias("module"), _unsigned(r, 9, 2, True).alias("flags"),
        _unsigned(r, 11, 2, True).alias("subcode"), _word(r, 16).alias("arg1"), _word(r, 20).alias("arg2"), _word(r, 26).alias("arg3"),
    )
    return out.where("s <> 0 and s <> 4294967295").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def read_binary_events(spark: SparkSession, root: str, glob: str = "*.bin", first: str | None = None, last: str | None = None) -> DataFrame:
    """Events of all binary files below ``root``; with a window only those in it, both ends included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")
    events = decode(files)
    if first is not None:
        events = events.where(F.col("ts") >= F.lit(first).cast("timestamp"))
    if last is not None:
        events = events.where(F.col("ts") <= F.lit(last).cast("timestamp"))
    return events


def encode(events: DataFrame, key: str) -> DataFrame:
    """Files (path, content) of events (key, rec_no, s, event_id, module): the inverse of ``decode`` for small files."""
    def number(c: str, size: int, little: bool) -> Column:
        digits = F.lpad(F.hex(F.col(c).cast("bigint")), size * 2, "0")
        return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]) if little else digits

    one = F.concat(number("s", 4, False), F.lit("00"), number("event_id", 2, True), number("module", 2, True), F.lit("0" * 46))
    rows = events.select(F.col(key).cast("string").alias("path"), "rec_no", one.alias("r"))
    joined = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "r"))), lambda x: x["r"]), "").alias("body"))
    return joined.select("path", F.unhex(F.concat(F.lit("0" * HEADER * 2), "body")).alias("content"))
