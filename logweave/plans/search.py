"""Retrieval queries over the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import search
from logweave.session import table


def interval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten earliest error events of a window."""
    events = table(spark, sf_dir, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") == "error"))
    return events.orderBy("ts", "event_id").limit(10).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "log_chunks")
    inside = F.col("has_time") & (F.col("time_end") >= F.lit("2016-01-10").cast("timestamp")) & (F.col("time_start") <= F.lit("2016-01-12").cast("timestamp"))
    return chunks.where(inside).select("id", "chunk_id")


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "log_chunks")
    found = chunks.where(F.col("content_text").ilike("%watchdog token%stalled%"))
    return found.orderBy(F.col("time_start").asc_nulls_last(), "source_path", "chunk_id", "id").limit(10).select("id", "chunk_id")


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents most similar to a pattern, above the usual threshold."""
    documents = table(spark, sf_dir, "documents")
    scored = documents.select("doc_id", F.round(search.similarity(F.col("text"), "watchdog token missed the handover"), 6).alias("sim")).where("sim > 0.15")
    return scored.orderBy(F.col("sim").desc(), "doc_id").limit(10)


def record_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.record_selector(table(spark, sf_dir, "log_chunks"), start_ts="2016-01-08", end_ts="2016-01-22", exact_pattern="axle bearing", limit=12)
    return found.select("id", "chunk_id")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "log_chunks")
    return search.neighbours(chunks.where(F.col("content_text").contains("panto.arm EMERGENCY") | F.col("content_text").contains("lost sync for 99")), chunks)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "log_chunks")
    return chunks.where((F.col("source_path") == "KRV-117/onboard/panel_a/live.log") & (F.col("chunk_id") == 3)).select("id", "source_path", "chunk_id")


def first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_per_source(table(spark, sf_dir, "log_chunks"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "log_chunks").select("id", "source_path", "chunk_id", "loaded_at")
    return search.latest_loads(chunks).select("id", "source_path", "chunk_id")


def chunk_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.key_violations(table(spark, sf_dir, "log_chunks"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.averaged_ranks(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", "p_brand", "avg_rank")


QUERIES = {
    "interval_topk": interval_topk, "interval_overlap": interval_overlap, "exact_search": exact_search, "fuzzy_search": fuzzy_search, "record_selector": record_selector,
    "neighbours": neighbours, "point_lookup": point_lookup, "first_record": first_record, "upsert_latest": upsert_latest, "chunk_key_violations": chunk_key_violations, "average_ranks": average_ranks,
}

SQL = {
    "interval_topk": """
select event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events
where ts between timestamp '2024-01-05' and timestamp '2024-01-20' and event_type = 'error' order by ts, event_id limit 10""",
    "interval_overlap": """
select id, chunk_id from log_chunks where has_time and time_end >= timestamptz '2016-01-10 00:00:00+00' and time_start <= timestamptz '2016-01-12 00:00:00+00'""",
    "exact_search": """
select id, chunk_id from (select id, chunk_id from log_chunks where content_text ilike '%watchdog token%stalled%' order by time_start nulls last, source_path, chunk_id, id limit 10)""",
    "fuzzy_search": r"""
with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as ws from documents where text is not null),
g as (select doc_id, list_distinct(flatten(list_transform(ws, lambda x: list_transform(range(1, length(x) + 2), lambda i: substring('  ' || x || ' ', i, 3))))) as own from w),
p as (select list_distinct(flatten(list_transform(['watchdog', 'token', 'missed', 'the', 'handover'], lambda x: list_transform(range(1, length(x) + 2), lambda i: substring('  ' || x || ' ', i, 3))))) as wanted),
s as (select doc_id, len(own) as a, len(wanted) as b, len(list_intersect(own, wanted)) as c from g, p)
select doc_id, round(c / (a + b - c), 6) as sim from s where a + b - c > 0 and round(c / (a + b - c), 6) > 0.15 order by sim desc, doc_id limit 10""",
    "record_selector": """
select id, chunk_id from (select id, chunk_id from log_chunks where has_time and time_end >= timestamptz '2016-01-08 00:00:00+00' and time_start <= timestamptz '2016-01-22 00:00:00+00'
and content_text ilike '%axle bearing%' order by time_start nulls last, source_path, chunk_id, id limit 12)""",
    "neighbours": """
select h.id as hit_id, c.id, c.chunk_id from log_chunks h join log_chunks c on h.source_path = c.source_path and abs(h.chunk_id - c.chunk_id) <= 2
where contains(h.content_text, 'panto.arm EMERGENCY') or contains(h.content_text, 'lost sync for 99')""",
    "point_lookup": "select id, source_path, chunk_id from log_chunks where source_path = 'KRV-117/onboard/panel_a/live.log' and chunk_id = 3",
    "first_record": """
select source_path, chunk_id, id from (select source_path, chunk_id, id, row_number() over (partition by source_path order by chunk_id, id) as place from log_chunks) where place = 1""",
    "upsert_latest": """
select id, source_path, chunk_id from (
  select id, source_path, chunk_id, row_number() over (partition by source_path, chunk_id order by loaded_at desc nulls last, id desc) as place from log_chunks) where place = 1""",
    "chunk_key_violations": """
select source_path, chunk_id, count(*) as n, count(*) filter (has_time and time_start > time_end) as reversed
from log_chunks group by source_path, chunk_id having count(*) > 1 or count(*) filter (has_time and time_start > time_end) > 0""",
    "average_ranks": """
select p_partkey, p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2 as avg_rank from part""",
}
