"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators import archive, intervals, log_lines, timestamps
from logweave.session import ship, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines.found_entries(table(ship(spark), sf_dir, "log_chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.found_periods(table(spark, sf_dir, "log_chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return timestamps.found_instants(table(spark, sf_dir, "staged_chunks"), table(spark, sf_dir, "ticket_rows"), table(spark, sf_dir, "vehicle_units"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.found_sources(table(ship(spark), sf_dir, "file_fragments"))


def p7_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the containers: where each piece lies."""
    containers = archive.pack(archive.best_deliveries(table(ship(spark), sf_dir, "file_fragments")))
    return containers.select("container_id", F.explode("entries").alias("e")).select("container_id", "e.path", "e.seq_no", "e.position", "e.size", "e.crc")


def p7_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the index with its size, and whether it begins where the one before it in its container ends."""
    order = W.partitionBy("container_id").orderBy("position", "size")
    ends = F.coalesce(F.lag(F.col("position") + F.col("size")).over(order), F.lit(0))
    return p7_index(spark, sf_dir).select("path", F.col("seq_no").cast("bigint").alias("seq_no"), F.col("size").cast("bigint").alias("size"), (ends == F.col("position")).alias("adjoins"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p6_found": p6_found, "p7_found": p7_found, "p7_index": p7_index, "p7_entries": p7_entries}

SQL = {
    "p7_entries": r"""
select p as path, cast(seq_no as bigint) as seq_no, max(octet_length(encode(coalesce(body, '')))) as size, true as adjoins
from (select replace(source_path, '\', '/') as p, * from file_fragments where source_path is not null and seq_no is not null) group by 1, 2""",
    "p2_found": r"""
with b as (
  select distinct replace(source_path, '\', '/') as p, epoch_us(time_start) as s, epoch_us(time_end) as e
  from log_chunks where has_time and time_start is not null and time_end is not null and time_start <= time_end and source_path is not null),
m as (select p, s, e, max(e) over (partition by p order by s, e rows between unbounded preceding and 1 preceding) as reach from b),
g as (select p, s, e, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by p order by s, e rows unbounded preceding) as no from m),
periods as (select p, no, min(s) as s, max(e) as e from g group by p, no)
select p as source_path, 'period' as kind, s as start_us, e as end_us from periods
union all
select p, 'gap', e, later from (select p, e, lead(s) over (partition by p order by s) as later from periods) where later is not null""",
    "p7_found": r"""
with f as (
  select replace(source_path, '\', '/') as p, seq_no, coalesce(body, '') as body,
         row_number() over (partition by replace(source_path, '\', '/'), seq_no order by octet_length(encode(coalesce(body, ''))) desc, arrived_at, fragment_id) as place
  from file_fragments where source_path is not null and seq_no is not null),
l as (select p, seq_no, unnest(string_split_regex(body, '\r\n|\r|\n')) as line from f where place = 1)
select p as source_path, count(distinct seq_no) as n_fragments, count(*) filter (regexp_matches(line, '\S')) as n_records,
       cast(coalesce(sum(octet_length(encode(line))) filter (regexp_matches(line, '\S')), 0) as bigint) as n_bytes
from l group by p having count(distinct seq_no) >= 2""",
}
