"""Structured Streaming forms of the batch operators (there is no streaming in the batch pipeline itself)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per key in tumbling windows; rows later than the watermark are dropped by Spark."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def first_loads(stream: DataFrame, keys: tuple[str, ...] = ("source_path", "chunk_id"), time: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def activity_sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: start, end, number of events."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
