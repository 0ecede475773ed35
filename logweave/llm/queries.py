"""Queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import nearest, packing, residue, runs, splitting, tokenizer
from logweave.session import ship, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found_large(table(ship(spark), sf_dir, "log_chunks"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(ship(spark), sf_dir, "log_chunks"))


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and hash of the text that the pieces of a chunk join to, and whether all of them fit."""
    whole = splitting.rejoined(splitting.split_chunks(table(ship(spark), sf_dir, "log_chunks")))
    return whole.select("id", "n_chars", "text_md5", (F.col("longest") <= splitting.MAX_CHARS).alias("fits"), (F.col("reached") == F.col("n_chars")).alias("joined"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.found_runs(table(ship(spark), sf_dir, "log_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    return nearest.found_matches(read("incidents"), read("ticket_rows"), read("match_results"), read("vehicle_units"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(ship(spark), sf_dir, "documents"))


def p9_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(ship(spark), sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found_residue(table(ship(spark), sf_dir, "documents"))


def p10_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remaining corpus."""
    return residue.remaining_corpus(table(ship(spark), sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined, "p4_found": p4_found, "p5_found": p5_found, "p8_ids": p8_ids, "p9_bins": p9_bins, "p10_found": p10_found, "p10_corpus": p10_corpus}

SQL = {
    "p3_found": r"""
select id, cast(list_max(list_transform(string_split_regex(content_text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: length(x))) > 3000 as int) as hard
from log_chunks where length(content_text) > 3000""",
    "p3_rejoined": "select id, cast(length(content_text) as int) as n_chars, md5(content_text) as text_md5, true as fits, true as joined from log_chunks where length(content_text) > 3000",
    "p4_found": r"""
with r as (select id, unnest(content_json) as e, unnest(range(0, len(content_json))) as pos from log_chunks where len(content_json) > 1),
k as (select id, pos, e.cnt as cnt, coalesce(e.ts_start, e.ts_end) as a, coalesce(e.ts_end, e.ts_start) as b,
  regexp_replace(regexp_replace(lower(coalesce(e.text, '')), '0x[0-9a-f]+|[0-9]+(\.[0-9]+)?', '#', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') as key from r),
o as (select *, case when key = lag(key) over (partition by id order by pos) then 0 else 1 end as opens from k),
g as (select *, sum(opens) over (partition by id order by pos rows unbounded preceding) as run from o)
select id, cast(min(pos) as int) as first_pos, cast(count(*) as int) as n_events, cast(coalesce(sum(cnt), 0) as bigint) as total_cnt,
       coalesce(cast((epoch_us(max(b)) - epoch_us(min(a))) // 1000 as bigint), -1) as duration_ms
from g group by id, run having count(*) > 1""",
    "p5_found": r"""
with u as (select distinct regexp_replace(upper(unit_code), '[^A-Z0-9]', '', 'g') as k from vehicle_units),
cells as (select ticket_id, unnest(list_zip(headers, row_values)) as c from ticket_rows),
t as (
  select distinct ticket_id, regexp_replace(upper(c[2]), '[^A-Z0-9]', '', 'g') as k
  from cells where lower(trim(c[1])) in ('vehicle', 'unit', 'train set') and trim(c[2]) <> ''),
i as (select incident_id, epoch_us(cast(mapped_date as timestamptz)) as at, k from incidents join t using (ticket_id) join u using (k) where mapped_date is not null),
r as (
  select result_id, epoch_us(cast(source_ts as timestamptz)) as at, regexp_replace(upper(regexp_extract(match_list[1].source_path, '^[^/\\]*')), '[^A-Z0-9]', '', 'g') as k
  from match_results where len(match_list) > 0),
j as (
  select incident_id, result_id, row_number() over (partition by incident_id order by abs(i.at - r.at), r.at, result_id) as place
  from i join r on i.k = r.k and abs(i.at - r.at) <= 2700000000)
select incident_id, result_id from j where place = 1""",
}
