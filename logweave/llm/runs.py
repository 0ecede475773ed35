"""Repeated consecutive events: associative run summaries.

A run summary is (key, first position, records, count, earliest start, latest
end).  Two neighbouring summaries of one sequence and one key merge into one;
the merge is associative, so blocks of an ordered sequence encode their runs
locally, and only the first and last run of each block, its edges, meet those
of its neighbours in a prefix merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.joins import small
from logweave.functions.prefix import running_sum
from logweave.session import ensure_checkpoint_dir

#: Records of one array that are encoded together; longer arrays have several blocks.
RECORDS_PER_BLOCK = 64
#: Blocks of one sequence whose edges are numbered together.
EDGES_PER_BLOCK = 100_000

#: What may differ between like texts, besides letter case.
NUMBER = r"0x[0-9a-f]+|[0-9]+(?:\.[0-9]+)?"
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"

_NONE_START, _NONE_END = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def like_text(text: pa.Array) -> pa.Array:
    """Texts without numbers, letter case and white space; null counts as empty."""
    low = pc.utf8_lower(pc.fill_null(text, ""))
    return pc.replace_substring_regex(pc.replace_substring_regex(low, NUMBER, "#"), BLANK, "")


def encode(breaks: np.ndarray, cnt: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Run summaries of ordered records; ``breaks`` holds the positions where runs begin."""
    sizes = np.diff(np.append(breaks, len(cnt)))
    return sizes, np.add.reduceat(cnt, breaks), np.minimum.reduceat(start, breaks), np.maximum.reduceat(end, breaks)


def _micros(values: pa.Array, other: pa.Array, none: int) -> np.ndarray:
    both = pc.coalesce(values, other)
    return pc.fill_null(both.cast(pa.int64()), none).to_numpy(zero_copy_only=False)


_SUMMARY = (
    ("sequence", pa.string(), "string"), ("block", pa.int64(), "bigint"), ("key", pa.string(), "string"), ("first_at", pa.int64(), "bigint"), ("n_events", pa.int64(), "bigint"),
    ("total_cnt", pa.int64(), "bigint"), ("first_us", pa.int64(), "bigint"), ("last_us", pa.int64(), "bigint"), ("opens_block", pa.bool_(), "boolean"), ("ends_block", pa.bool_(), "boolean"),
)
_SUMMARY_SCHEMA = pa.schema([(name, kind) for name, kind, _ in _SUMMARY])
_SUMMARY_DDL = ", ".join(f"{name} {kind}" for name, _, kind in _SUMMARY)
_VALUES = ["sequence", "first_at", "n_events", "total_cnt", "first_us", "last_us"]


def merged_runs(encoded: DataFrame) -> DataFrame:
    """Runs of sequences from the summaries of their blocks: sequence, first_at, n_events, total_cnt, first_us, last_us.

    ``encoded``: the columns of ``_SUMMARY``; the blocks of a sequence are
    numbered without holes; opens_block and ends_block mark the edges, a
    summary without either is a whole run.  An edge that opens a block joins
    the one that ends the block before it if the keys agree.  Edges are
    linked by an equi-join and numbered by block sums, so that a sequence of
    any length is merged in many tasks.
    """
    edges = encoded.where("opens_block or ends_block")
    ends = edges.where("ends_block").select("sequence", (F.col("block") + 1).alias("block"), F.col("key").alias("ended"))
    linked = edges.join(ends, ["sequence", "block"], "left")
    follows = F.coalesce(F.col("opens_block") & (F.col("ended") == F.col("key")), F.lit(False))
    placed = linked.withColumns({"opens": (~follows).cast("int"), "place": 2 * F.col("block") + (~F.col("opens_block")).cast("int")})
    joined = (
        running_sum(placed, ["sequence"], "place", "opens", 2 * EDGES_PER_BLOCK, name="run")
        .groupBy("sequence", "run")
        .agg(F.min("first_at").alias("first_at"), F.sum("n_events").alias("n_events"), F.sum("total_cnt").alias("total_cnt"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    )
    return encoded.where("not opens_block and not ends_block").select(_VALUES).unionByName(joined.select(_VALUES))


def _digest(key: str) -> str:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def array_runs(chunks: DataFrame, per_block: int = RECORDS_PER_BLOCK, least: int = 2) -> DataFrame:
    """Run summaries of the record arrays of ``chunks`` (id, content_json), block by block, as ``merged_runs`` reads them.

    The sequence is the row, as ``number:id``; positions count from 0.  Runs
    inside a block of fewer than ``least`` records are left out.
    """

    def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            records = lists.flatten()
            if not len(records):
                continue
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(lengths) - lengths
            fields = {f.name: pc.struct_field(records, f.name) for f in records.type}
            words = like_text(fields["text"]).dictionary_encode()
            keys = words.indices.to_numpy(zero_copy_only=False)
            opens = np.empty(len(keys), bool)
            opens[0] = True
            opens[1:] = keys[1:] != keys[:-1]
            opens[first[lengths > 0]] = True
            breaks = np.flatnonzero(opens)
            cnt = pc.fill_null(fields["cnt"], 0).to_numpy(zero_copy_only=False)
            start = _micros(fields["ts_start"], fields["ts_end"], _NONE_START)
            end = _micros(fields["ts_end"], fields["ts_start"], _NONE_END)
            sizes, counts, starts, ends = encode(breaks, cnt, start, end)
            owner = np.repeat(np.arange(len(lengths)), lengths)[breaks]
            block = batch.column(1).to_numpy(zero_copy_only=False)[owner]
            last_block = batch.column(2).to_numpy(zero_copy_only=False)[owner]
            at = breaks - first[owner]
            # only blocks with a neighbour have edges: the first block has none before it, the last none behind
            opens_block = (at == 0) & (block > 0)
            ends_block = (at + sizes == lengths[owner]) & (block < last_block)
            keep = np.flatnonzero((sizes >= least) | opens_block | ends_block)
            edge = (opens_block | ends_block)[keep]
            digest = [_digest(words.dictionary[int(k)].as_py()) if e else None for k, e in zip(keys[breaks[keep]], edge, strict=True)]
            none = starts[keep] == _NONE_START
            columns = [
                batch.column(0).take(pa.array(owner[keep])), pa.array(block[keep]), pa.array(digest, pa.string()), pa.array((at + block * per_block)[keep]), pa.array(sizes[keep]), pa.array(counts[keep], pa.int64()),
                pa.array(starts[keep], mask=none), pa.array(ends[keep], mask=none), pa.array(opens_block[keep]), pa.array(ends_block[keep]),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SUMMARY_SCHEMA, strict=True)], schema=_SUMMARY_SCHEMA)

    size = F.size("content_json")
    last = F.floor((size - 1) / per_block).cast("bigint")
    sequence = F.concat_ws(":", F.monotonically_increasing_id().cast("string"), F.col("id").cast("string"))
    several = chunks.where(size >= least).select(sequence.alias("sequence"), last.alias("last_block"), "content_json")
    parts = F.when(F.col("last_block") == 0, F.array("content_json")).otherwise(F.transform(F.sequence(F.lit(0), F.col("last_block").cast("int")), lambda i: F.slice("content_json", i * per_block + 1, F.lit(per_block))))
    blocks = several.select("sequence", "last_block", F.posexplode(parts).alias("block", "records")).select("sequence", F.col("block").cast("bigint").alias("block"), "last_block", "records")
    return blocks.mapInArrow(encode_blocks, _SUMMARY_DDL)


def found_runs(chunks: DataFrame, per_block: int = RECORDS_PER_BLOCK, least: int = 2) -> DataFrame:
    """Runs of ``least`` records or more in the record arrays: (id, first_pos, n_events, total_cnt, duration_ms).

    Null or empty arrays have no runs; a null record counts as one with an
    empty text; null counts add nothing; duration is -1 without any time.
    Repeated rows have their runs each; other columns are not read.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    runs = merged_runs(array_runs(chunks, per_block, least).checkpoint()).where(F.col("n_events") >= least)
    owner = F.split("sequence", ":")
    duration = F.coalesce(F.floor((F.col("last_us") - F.col("first_us")) / 1000), F.lit(-1)).cast("bigint")
    return runs.select(
        F.get(owner, F.lit(1)).cast("bigint").alias("id"), F.col("first_at").cast("int").alias("first_pos"), F.col("n_events").cast("int").alias("n_events"), "total_cnt", duration.alias("duration_ms")
    )


def like_column(text: Column) -> Column:
    """``like_text`` as an expression."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, NUMBER, "#"), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", "")


def collapse_events(events: DataFrame) -> DataFrame:
    """Runs of event sequences of any length: sequence, first_at, n_events, total_cnt, first_us, last_us.

    ``events``: sequence, at (orders the sequence), text, cnt, start_us,
    end_us.  Range partitioning splits a long sequence over many tasks; each
    encodes its runs, and ``merged_runs`` joins the first and last runs of
    neighbouring partitions: two rows of each partition, however many events
    there are.  Equal ``at`` values stay in the order of their text.  A null
    text counts as empty, a null count as nothing; rows without sequence form
    a sequence of their own.
    """
    ensure_checkpoint_dir(events.sparkSession)
    slim = events.select(
        F.coalesce(F.col("sequence").cast("string"), F.lit("")).alias("sequence"), F.col("at").cast("bigint").alias("at"), F.md5(like_column(F.col("text"))).alias("key"),
        F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("cnt"), F.coalesce("start_us", "end_us").alias("start_us"), F.coalesce("end_us", "start_us").alias("end_us"),
    )
    spread = slim.repartitionByRange("sequence", "at", "key").sortWithinPartitions("sequence", "at", "key")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        held = None

        def out(rows: list[list], last: bool) -> pa.RecordBatch:
            nonlocal first
            full = [[r[0], part, *r[1:], first and i == 0, last and i == len(rows) - 1] for i, r in enumerate(rows)]
            first = False
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(_SUMMARY_SCHEMA)], schema=_SUMMARY_SCHEMA)

        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, key, at = batch.column(0), batch.column(2), batch.column(1)
            opens = np.empty(batch.num_rows, bool)
            opens[0] = True
            opens[1:] = pc.or_(pc.not_equal(sequence[1:], sequence[:-1]), pc.not_equal(key[1:], key[:-1])).to_numpy(zero_copy_only=False)
            breaks = np.flatnonzero(opens)
            start = pc.fill_null(batch.column(4), _NONE_START).to_numpy(zero_copy_only=False)
            end = pc.fill_null(batch.column(5), _NONE_END).to_numpy(zero_copy_only=False)
            summaries = encode(breaks, batch.column(3).to_numpy(zero_copy_only=False), start, end)
            where = pa.array(breaks)
            rows = [
                [s, k, a, n, c, None if f == _NONE_START else f, None if e == _NONE_END else e]
                for s, k, a, n, c, f, e in zip(*(x.take(where).to_pylist() for x in (sequence, key, at)), *(x.tolist() for x in summaries), strict=True)
            ]
            if held is not None:
                if held[:2] == rows[0][:2]:
                    rows[0] = merge(held, rows[0])
                else:
                    rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield out(rows, False)
        if held is not None:
            yield out([held], True)

    encoded = spread.mapInArrow(local, _SUMMARY_DDL).checkpoint()
    # partitions without rows leave no hole in the numbers; one row for each partition
    parts = encoded.select(F.col("block").alias("part")).distinct().select("part", (F.row_number().over(W.orderBy("part")) - 1).cast("bigint").alias("dense"))
    numbered = encoded.join(small(parts), encoded["block"] == parts["part"]).withColumn("block", F.col("dense")).drop("part", "dense")
    return merged_runs(numbered)


def merge(a: list, b: list) -> list:
    """Two neighbouring summaries of one sequence and key as one."""
    firsts = [x for x in (a[5], b[5]) if x is not None]
    lasts = [x for x in (a[6], b[6]) if x is not None]
    return [*a[:3], a[3] + b[3], a[4] + b[4], min(firsts, default=None), max(lasts, default=None)]
