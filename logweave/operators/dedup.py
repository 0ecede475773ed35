"""Deduplication of event lines, splitting of long lines and packing into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.prefix import ranked


def event_records(chunks: DataFrame) -> DataFrame:
    """Records of event chunks, one row each: source_path, id, pos, ts_start, ts_end, cnt, text."""
    records = chunks.select("source_path", "id", F.posexplode("content_json").alias("pos", "r"))
    return records.select("source_path", "id", "pos", "r.ts_start", "r.ts_end", "r.cnt", "r.text")


def dedup_lines(records: DataFrame) -> DataFrame:
    """Per source and exact text: first and last time and number of events; unknown times are ignored."""
    return records.groupBy("source_path", "text").agg(F.min("ts_start").alias("ts_start"), F.max(F.coalesce("ts_end", "ts_start")).alias("ts_end"), F.sum(F.coalesce("cnt", F.lit(1))).alias("cnt"))


def reduction(records: DataFrame) -> DataFrame:
    """Per source: events, distinct texts, and the share saved by deduplication."""
    per_text = dedup_lines(records)
    totals = per_text.groupBy("source_path").agg(F.sum("cnt").alias("n_events"), F.count("*").alias("n_texts"))
    return totals.withColumn("reduction", F.round(F.coalesce(1 - F.try_divide("n_texts", "n_events"), F.lit(0.0)), 6))


def timeline(deduped: DataFrame, width: int = 3_600_000_000) -> DataFrame:
    """``place`` of every line in the timeline of its source: unknown times first, then by last time, then by the hash of the text."""
    at = F.coalesce(F.unix_micros("ts_end"), F.lit(-(1 << 60)))
    placed = ranked(deduped.withColumns({"__at": at, "__hash": F.md5("text")}), ["source_path"], "__at", width, ("__hash",))
    return placed.withColumnRenamed("rank", "place").drop("__at", "__hash")


def fixed_pieces(text: Column, size: Column | int) -> Column:
    """Equal pieces of a long text, the last one shorter; an empty text is one empty piece."""
    k = F.lit(size) if isinstance(size, int) else size
    n = F.greatest(F.ceil(F.length(text) / k), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * k + 1, k))


def record_length(ts: Column, text: Column) -> Column:
    """Length of a record as it is packed: an unknown time counts four characters."""
    return F.coalesce(F.length(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")), F.lit(4)) + F.length(text)


def packed_chunks(lengths: Column, max_size: int) -> Column:
    """Greedy packing of ordered lengths: the chunk number of each, from 0.

    A record joins the chunk while it fits; one that is too long for any
    chunk stands alone.  Arrow batches of whole lists, in time that follows
    their length; a null list stays null, a null length counts nothing.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pack(lists: pd.Series) -> pd.Series:
        return lists.map(lambda sizes: None if sizes is None else pack_sequence([0 if s != s or s is None else int(s) for s in sizes], max_size))

    return pack(lengths)


def pack_sequence(sizes: list[int], max_size: int) -> list[int]:
    """``packed_chunks`` of one long list."""
    out, chunk, used = [], -1, 0
    for size in sizes:
        if chunk >= 0 and used + size <= max_size:
            used += size
        else:
            chunk, used = chunk + 1, size
        out.append(chunk)
    return out


def recursive_split(text: str, size: int, overlap: int = 10, separators: tuple[str, ...] = ("\n\n", "\n", "\t", " ", "")) -> list[str]:
    """Pieces of a text up to ``size`` characters, split at the first separator that occurs.

    A separator stays at the start of the piece behind it; pieces that are
    still too long are split by the later separators; neighbours are merged
    up to the size, and whole trailing parts of up to ``overlap`` characters
    are repeated.  White space around pieces is stripped, empty ones dropped.
    """
    mark = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(mark) + 1 :]
    if mark:
        raw = text.split(mark)
        parts = [raw[0]] + [mark + p for p in raw[1:]]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        total, window = 0, []
        for part in held:
            if window and total + len(part) > size:
                joined = "".join(window).strip()
                if joined:
                    out.append(joined)
                while window and (total > overlap or total + len(part) > size):
                    total -= len(window.pop(0))
            window.append(part)
            total += len(part)
        joined = "".join(window).strip()
        if joined:
            out.append(joined)
        held.clear()

    for part in parts:
        if not part:
            continue
        if len(part) <= size:
            held.append(part)
            continue
        flush()
        out.extend(recursive_split(part, size, overlap, rest) if rest else [part])
    flush()
    return out


def recursive_pieces(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, piece_no, piece) of the texts longer than ``size``."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, p) for k, t in zip(batch[key], batch[text], strict=True) for i, p in enumerate(recursive_split(t, size))]
            yield pd.DataFrame(out, columns=[key, "piece_no", "piece"])

    long_ones = rows.where(F.length(text) > size).select(key, text)
    return long_ones.mapInPandas(split, f"{key} {dict(rows.dtypes)[key]}, piece_no int, piece string")


def time_span(chunks: DataFrame) -> DataFrame:
    """(id, n_records, first_us, last_us) of the records of every chunk; null where no time is known."""
    starts = F.transform("content_json", lambda r: F.coalesce(r["ts_start"], r["ts_end"]))
    ends = F.transform("content_json", lambda r: F.coalesce(r["ts_end"], r["ts_start"]))
    return chunks.select("id", F.size("content_json").cast("bigint").alias("n_records"), F.unix_micros(F.array_min(starts)).alias("first_us"), F.unix_micros(F.array_max(ends)).alias("last_us"))
