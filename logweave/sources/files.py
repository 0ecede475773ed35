"""File trees: recursive scans, text and chunk sources, windowed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.paths import path_anchor
from logweave.operators import records
from logweave.operators.catalog import file_kind, file_name
from logweave.sources.binary import decode

#: Fixed value: schema of the records of a chunk.
CONTENT = T.ArrayType(
    T.StructType([T.StructField("ts_start", T.TimestampType()), T.StructField("ts_end", T.TimestampType()), T.StructField("cnt", T.LongType()), T.StructField("text", T.StringType())])
)
CHUNK = T.StructType([T.StructField("source", T.StringType()), T.StructField("chunk_id", T.IntegerType()), T.StructField("content", CONTENT), T.StructField("broken", T.StringType())])


def scan_files(spark: SparkSession, root: str, glob: str | None = None, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Every file below ``root``: path, name, n_bytes, modified.  Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    return files.where(~F.col("name").isin(*ignored)) if ignored else files


def text_lines(spark: SparkSession, root: str, glob: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Lines of text files: path, line_no from 0, line; all kinds of line ends.

    Bytes that are no UTF-8 become replacement characters.  ``kinds`` keeps
    only files of those kinds.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", "content")
    if kinds is not None:
        files = files.where(file_kind(file_name(F.col("path"))).isin(*kinds))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))


def windowed_records(spark: SparkSession, root: str, first: str, last: str, static: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Records of all files below ``root`` whose time lies in the window: path, line_no, ts, n_lines, text.

    Binary event files give their events, one record each, as JSON; other
    files are read as text, with the date of their path for lines before the
    first time (see ``records.assemble_texts``).  ``kinds`` keeps only files
    of those kinds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content").withColumn("kind", file_kind(file_name(F.col("path"))))
    if kinds is not None:
        files = files.where(F.col("kind").isin(*kinds))
    begin, end = F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")
    texts = files.where("kind <> 'bin'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), path_anchor(F.col("path"))["at"].alias("anchor"))
    events = decode(files.where("kind = 'bin'").select("path", "content")).where(F.col("ts").between(begin, end))
    fields = F.to_json(F.struct("event_id", "module", "flags", "subcode", "arg1", "arg2", "arg3"))
    of_events = events.select("path", F.col("rec_no").alias("line_no"), "ts", F.lit(1).alias("n_lines"), fields.alias("text"))
    return records.assemble_texts(texts, "path", "text", "anchor", begin, end, static).unionByName(of_events)


def write_windowed(found: DataFrame, folder: str, keys: tuple[str, ...] = ("incident_ts",)) -> None:
    """Records partitioned by incident; only the partitions that are written again are replaced."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


def write_plain(found: DataFrame, folder: str) -> None:
    """Records as text lines ``time: text``, each source under a header of its path."""
    body = F.concat_ws(": ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "text")
    header = found.select("path").distinct().select("path", F.lit(-1).alias("line_no"), F.col("path").alias("value"))
    rows = header.unionByName(found.select("path", "line_no", body.alias("value")))
    rows.repartition("path").sortWithinPartitions("path", "line_no").select("value").write.mode("overwrite").text(folder)


def read_chunks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Chunk files (JSON lines): valid chunks as table rows, and broken lines.

    A chunk needs a source, a chunk_id and a non-empty content.
    """
    read = spark.read.schema(CHUNK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True).json(root)
    valid = F.col("broken").isNull() & F.col("source").isNotNull() & F.col("chunk_id").isNotNull() & (F.size("content") > 0)
    return chunk_rows(read.where(F.coalesce(valid, F.lit(False)))), read.where(~F.coalesce(valid, F.lit(False)))


def clean_text(text: Column) -> Column:
    """Runs of control characters become one blank."""
    return F.trim(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]+", " "))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunk records (source, chunk_id, content) as rows of the chunk table."""
    content = F.transform("content", lambda r: F.struct(r["ts_start"].alias("ts_start"), r["ts_end"].alias("ts_end"), F.coalesce(r["cnt"], F.lit(1)).alias("cnt"), clean_text(r["text"]).alias("text")))
    rows = chunks.select(F.col("source").alias("source_path"), "chunk_id", content.alias("content_json"))
    starts = F.transform("content_json", lambda r: F.coalesce(r["ts_start"], r["ts_end"]))
    ends = F.transform("content_json", lambda r: F.coalesce(r["ts_end"], r["ts_start"]))
    texts = F.array_join(F.transform("content_json", lambda r: r["text"]), "\n")
    spanned = rows.withColumns({"content_text": F.concat("source_path", F.lit("\n"), texts), "time_start": F.array_min(starts), "time_end": F.array_max(ends)})
    return spanned.withColumn("has_time", F.col("time_start").isNotNull())


def write_chunks(rows: DataFrame, folder: str) -> None:
    """Rows of the chunk table as chunk files that ``read_chunks`` reads."""
    rows.select(F.col("source_path").alias("source"), "chunk_id", F.col("content_json").alias("content")).write.mode("overwrite").json(folder)


def read_incidents(spark: SparkSession, incidents: str, coverage: str | None = None) -> DataFrame:
    """Incidents (JSON map of times to entries), left-joined with a coverage map of the same keys."""
    entry = "map<string, struct<normalized_timestamp:string, matched_date:string, had_date_overlap:boolean>>"
    def exploded(path: str, schema: str, name: str) -> DataFrame:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", schema)).alias("source_ts", name))

    rows = exploded(incidents, entry, "entry").select("source_ts", "entry.*")
    if coverage is None:
        return rows
    return rows.join(exploded(coverage, "map<string, map<string, array<string>>>", "files"), "source_ts", "left")


def timestamp_keys(spark: SparkSession, path: str) -> DataFrame:
    """Top-level keys of a JSON map that are times, as UTC seconds with their number of entries."""
    whole = spark.read.text(path, wholetext=True)
    keys = whole.select(F.explode(F.json_object_keys("value")).alias("key"))
    return keys.select("key", F.date_trunc("second", F.try_to_timestamp("key")).alias("at")).where("at is not null").groupBy("at").agg(F.count("*").alias("n"))
