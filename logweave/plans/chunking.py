"""Deduplication, splitting and packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.paths import path_anchor
from logweave.operators import dedup, records
from logweave.operators.log_lines import is_raw, raw_chunks
from logweave.plans.records import RECORDS_SQL
from logweave.session import ship, table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of event chunks, and those assembled from raw chunks, whose texts hold ``<time>`` in place of their time."""
    chunks = table(spark, sf_dir, "log_chunks")
    raw = raw_chunks(chunks).select(F.struct("id", "source_path").alias("key"), "text", path_anchor(F.col("source_path"))["at"].alias("anchor"))
    assembled = records.assemble_texts(raw, "key", "text", "anchor").select("key.source_path", F.col("ts").alias("ts_start"), F.col("ts").alias("ts_end"), F.lit(1).cast("bigint").alias("cnt"), "text")
    return dedup.event_records(chunks.where(~F.coalesce(is_raw(), F.lit(False)))).drop("id", "pos").unionByName(assembled)


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.dedup_lines(_records(spark, sf_dir))
    return rows.select("source_path", F.md5("text").alias("text_md5"), F.unix_micros("ts_start").alias("first_us"), F.unix_micros("ts_end").alias("last_us"), "cnt")


def dedup_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.reduction(_records(spark, sf_dir))


def dedup_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every deduplicated line in the timeline of its source."""
    rows = dedup.dedup_lines(_records(spark, sf_dir))
    return dedup.timeline(rows).select("source_path", F.md5("text").alias("text_md5"), "place")


def chunk_fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 1,000 characters in pieces of 1,000."""
    long_ones = table(spark, sf_dir, "documents").where(F.length("text") > 1000)
    pieces = long_ones.select("doc_id", F.posexplode(dedup.fixed_pieces(F.col("text"), 1000)).alias("piece_no", "piece"))
    return pieces.select("doc_id", "piece_no", F.md5("piece").alias("piece_md5"))


def chunk_recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.recursive_pieces(table(ship(spark), sf_dir, "documents"), "doc_id", "text", 1000)


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each event chunk packed anew into chunks of at most 500 characters."""
    chunks = table(spark, sf_dir, "log_chunks")
    lengths = F.transform("content_json", lambda r: F.coalesce(F.length(r["text"]), F.lit(0)) + F.when(r["ts_start"].isNull(), 4).otherwise(19))
    packed = chunks.select("id", dedup.packed_chunks(lengths, 500).alias("marks"))
    return packed.select("id", F.explode("marks").alias("new_chunk")).groupBy("id", "new_chunk").agg(F.count("*").alias("n_records"))


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.time_span(table(spark, sf_dir, "log_chunks"))


QUERIES = {
    "dedup_lines": dedup_lines, "dedup_reduction": dedup_reduction, "dedup_timeline": dedup_timeline, "chunk_fixed_split": chunk_fixed_split,
    "chunk_recursive_split": chunk_recursive_split, "chunk_pack": chunk_pack, "chunk_sizes": chunk_sizes,
}

_RECORDS = f"""{RECORDS_SQL}, r as (select source_path, id, unnest(content_json) as e from log_chunks where not coalesce(len(content_json) = 1 and content_json[1].ts_start is null, false)),
f as (select source_path, e.ts_start as ts_start, e.ts_end as ts_end, e.cnt as cnt, e.text as text from r union all select source_path, moment, moment, 1, g.text from g join log_chunks using (id))"""

SQL = {
    "dedup_lines": f"""
with {_RECORDS}
select source_path, md5(text) as text_md5, epoch_us(min(ts_start)) as first_us, epoch_us(max(coalesce(ts_end, ts_start))) as last_us, cast(sum(coalesce(cnt, 1)) as bigint) as cnt
from f group by source_path, text""",
    "dedup_reduction": f"""
with {_RECORDS}, sums as (select source_path, text, sum(coalesce(cnt, 1)) as c from f group by source_path, text)
select source_path, cast(sum(c) as bigint) as n_events, count(*) as n_texts, round(coalesce(1 - count(*) / nullif(sum(c), 0), 0), 6) as reduction from sums group by source_path""",
    "dedup_timeline": f"""
with {_RECORDS}, lasts as (select source_path, text, max(coalesce(ts_end, ts_start)) as e from f group by source_path, text)
select source_path, md5(text) as text_md5, row_number() over (partition by source_path order by e nulls first, md5(text)) as place from lasts""",
    "chunk_fixed_split": """
with p as (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 1000.0) as bigint))) as i from documents where length(text) > 1000)
select doc_id, cast(i as int) as piece_no, md5(substring(text, i * 1000 + 1, 1000)) as piece_md5 from p""",
    "chunk_pack": """
with recursive l as (select id, list_transform(content_json, lambda r: coalesce(length(r.text), 0) + case when r.ts_start is null then 4 else 19 end) as ls from log_chunks where len(content_json) > 0),
fold as (
  select id, ls, 1 as i, 0 as chunk, ls[1] as used from l
  union all
  select id, ls, i + 1, case when used + ls[i + 1] <= 500 then chunk else chunk + 1 end, case when used + ls[i + 1] <= 500 then used + ls[i + 1] else ls[i + 1] end from fold where i < len(ls))
select id, chunk as new_chunk, count(*) as n_records from fold group by id, chunk""",
    "chunk_sizes": """
select id, len(content_json) as n_records, epoch_us(list_min(list_transform(content_json, lambda r: coalesce(r.ts_start, r.ts_end)))) as first_us,
       epoch_us(list_max(list_transform(content_json, lambda r: coalesce(r.ts_end, r.ts_start)))) as last_us from log_chunks""",
}
