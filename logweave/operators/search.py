"""Chunk store: upsert, exact, fuzzy, interval and neighbour retrieval, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_loads(chunks: DataFrame, keys: tuple[str, ...] = ("source_path", "chunk_id"), order: tuple[str, ...] = ("loaded_at", "id")) -> DataFrame:
    """One row per key, the last one loaded (upsert semantics).

    A partial ``max_by`` keeps one row per key on the map side, so many loads
    of one chunk do not meet in one task.
    """
    row = F.struct(*[F.col(c) for c in chunks.columns])
    order_by = F.struct(*[F.col(c) for c in order])
    return chunks.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, order_by).alias("row")).select("row.*")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(text: Column, pattern: str) -> Column:
    """Trigram similarity of a text and a fixed pattern: shared over all distinct trigrams, 0 if there are none."""
    wanted = sorted({g for word in set("".join(c if c.isalnum() else " " for c in pattern.lower()).split()) for g in (f"  {word} "[i : i + 3] for i in range(len(word) + 1))})
    own = trigrams(F.coalesce(text, F.lit("")))
    shared = F.size(F.array_intersect(own, F.array(*[F.lit(g) for g in wanted]))) if wanted else F.lit(0)
    union = F.size(own) + F.lit(len(wanted)) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def record_selector(
    chunks: DataFrame, source_path: str | None = None, start_ts: str | None = None, end_ts: str | None = None,
    exact_pattern: str | None = None, similarity_pattern: str | None = None, limit: int = 1, threshold: float = 0.01,
) -> DataFrame:
    """The search of the agent: any subset of the predicates, joined by AND.

    Without a similarity pattern the earliest come first (unknown times last);
    with one, the most similar.  Ties go by source_path, chunk_id and id.  The
    conjunction stays one Catalyst filter, so that time and path predicates
    reach the scan, and the order is a bounded top-k.
    """
    if not 1 <= limit <= 12:
        raise ValueError("limit must lie between 1 and 12")
    found = chunks
    if source_path is not None:
        found = found.where(F.col("source_path") == source_path)
    if start_ts is not None or end_ts is not None:
        found = found.where("has_time")
    if start_ts is not None:
        found = found.where(F.col("time_end") >= F.lit(start_ts).cast("timestamp"))
    if end_ts is not None:
        found = found.where(F.col("time_start") <= F.lit(end_ts).cast("timestamp"))
    if exact_pattern is not None:
        found = found.where(F.col("content_text").ilike(f"%{exact_pattern}%"))
    ties = [F.col("source_path").asc(), F.col("chunk_id").asc(), F.col("id").asc()]
    if similarity_pattern is not None:
        scored = found.withColumn("sim", similarity(F.col("content_text"), similarity_pattern)).where(F.col("sim") > threshold)
        return scored.orderBy(F.col("sim").desc(), *ties).limit(limit)
    return found.orderBy(F.col("time_start").asc_nulls_last(), *ties).limit(limit)


def neighbours(hits: DataFrame, chunks: DataFrame, width: int = 2) -> DataFrame:
    """Chunks within ``width`` ids of a hit in the same source: (hit_id, id, chunk_id).

    Each hit is exploded to the ids it asks for, so the join is an equi-join.
    """
    asked = hits.select(F.col("id").alias("hit_id"), "source_path", F.explode(F.sequence(F.col("chunk_id") - width, F.col("chunk_id") + width)).alias("chunk_id"))
    return asked.join(chunks.select("source_path", "chunk_id", "id"), ["source_path", "chunk_id"]).select("hit_id", "id", "chunk_id")


def key_violations(chunks: DataFrame) -> DataFrame:
    """What the constraints of the chunk table would refuse: (source_path, chunk_id, n, reversed)."""
    reverse = F.col("has_time") & (F.col("time_start") > F.col("time_end"))
    return (
        chunks.groupBy("source_path", "chunk_id")
        .agg(F.count("*").alias("n"), F.count_if(F.coalesce(reverse, F.lit(False))).alias("reversed"))
        .where("n > 1 or reversed > 0")
    )


def first_per_source(chunks: DataFrame) -> DataFrame:
    """The first chunk of every source."""
    place = F.struct("chunk_id", "id")
    return chunks.groupBy("source_path").agg(F.min(place).alias("first")).select("source_path", F.col("first.chunk_id").alias("chunk_id"), F.col("first.id").alias("id"))


def averaged_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``avg_rank`` within keys, equal values share the mean of their places; a null key or value has none.

    Equal values are counted first, so the window runs over distinct values,
    not over rows.
    """
    counts = rows.where(" and ".join(f"`{c}` is not null" for c in (*keys, value))).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranks = counts.select(*keys, value, (upto - (F.col("__n") - 1) / 2).alias("avg_rank"))
    return rows.join(ranks, [*keys, value], "left")
