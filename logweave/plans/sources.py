"""Queries that exercise sources on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.sources import binary
from logweave.session import table
from logweave.streaming import live


def binary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as binary files, one per user and day, and decoded again."""
    events = table(spark, sf_dir, "events")
    file = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
    rows = events.select(
        file.alias("file"), F.row_number().over(W.partitionBy(file).orderBy("ts", "event_id")).alias("rec_no"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"),
        F.pmod("event_id", F.lit(65536)).alias("event_id"), F.pmod("user_id", F.lit(65536)).alias("module"),
    )
    decoded = binary.decode(binary.encode(rows, "file"))
    return decoded.select("path", F.col("rec_no").cast("bigint").alias("rec_no"), F.unix_seconds("ts").alias("s"), "event_id", "module")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming counts."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.event_counts(events, window="1 day").select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming sessions."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.activity_sessions(events, "user_id", gap="12 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


QUERIES = {"binary_decode": binary_decode, "window_counts": window_counts, "user_sessions": user_sessions}

SQL = {
    "binary_decode": """select user_id || '-' || strftime(ts, '%Y%m%d') as path, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as rec_no, cast(floor(epoch(ts)) as bigint) as s,
event_id % 65536 as event_id, user_id % 65536 as module from events""",
    "window_counts": "select cast(epoch(date_trunc('day', ts)) as bigint) as start_s, event_type, count(*) as n from events group by 1, 2",
    "user_sessions": """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 12 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 12 hour) as end_us, count(*) as n from s group by user_id, no""",
}
