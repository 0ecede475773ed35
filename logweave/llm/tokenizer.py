"""Encoding of a corpus with a public byte-level BPE vocabulary.

Contiguous rank array: a word holds the boundaries of its parts and the rank
of every adjacent pair in two arrays side by side; the least rank is found by
a scan, its inner boundary is deleted and the two ranks beside it are
refreshed, until no pair has a rank.  Words are short, so the scan over
contiguous memory beats any pointer structure; a word beyond ``LONG`` bytes
takes an exact priority queue instead, as repeated scans of it would be
quadratic.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary parts texts into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 160
#: Words that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 400_000
#: Texts that are encoded before their ids are handed on.
TEXTS_PER_BATCH = 1_000

_NO_RANK = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    rank_of = ranks.get
    pair = [rank_of(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == _NO_RANK:
            break
        at = pair.index(least)
        del bounds[at + 1], pair[at]
        if at < len(pair):
            pair[at] = rank_of(word[bounds[at] : bounds[at + 2]], _NO_RANK)
        if at:
            pair[at - 1] = rank_of(word[bounds[at - 1] : bounds[at + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: the least pair comes from a heap, neighbours are linked."""
    n = len(word)
    following, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if not alive[a] or b >= n or not alive[b] or following[a] != b or end[a] != b or end[b] != stop:
            continue
        alive[b] = False
        end[a] = stop
        following[a] = after = following[b]
        if after < n:
            before[after] = a
            rank = ranks.get(word[a : end[after]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, after, end[after]))
        left = before[a]
        if left >= 0:
            rank = ranks.get(word[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, a, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Texts to ids; remembers the ids of the words it has met."""

    def __init__(self, data: bytes) -> None:
        self.ranks = read_ranks(data)
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= LONG else merge_long(raw, self.ranks)
        if len(raw) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        known, read = self.known.get, self.word
        for word in self.words(text):
            out += known(word) or read(word)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, read = self.known.get, self.word
        return sum(len(known(word) or read(word)) for word in self.words(text))


_encoders: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary file, one in each worker."""
    key = zlib.crc32(data)
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


@lru_cache(maxsize=4)
def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document: one pass, no shuffle.

    A null and an empty text both give an empty list; repeated rows are
    encoded each; other columns are not read.  The vocabulary (under 1 MB) is
    read by the driver and broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_file(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch, offsets, flat = whole.slice(first, TEXTS_PER_BATCH), [0], []
                for text in batch.column(1):
                    flat += own.encode(text.as_py())
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(_file(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            sizes = [own.count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, n_tokens int")
