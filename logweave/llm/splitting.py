"""Splitting oversized items at natural boundaries: content-defined chunking.

A rolling hash over the last ``WINDOW`` characters sets landmarks.  Of the
landmarks between the minimum and the maximum size the one with the least
hash snaps to the nearest natural boundary, a line end before a sentence end
before a blank; where there is none the landmark itself is the cut.
Landmarks and their hashes depend on the text around them only, and two
pieces that begin at different places mostly see the same least one: an edit
alters the pieces next to it and the later ones meet the old boundaries
again, in unbroken text too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.batches import ROWS_PER_BATCH, record_batch

MAX_CHARS, MIN_CHARS, OVERLAP = 3000, 1200, 10
#: Characters that the rolling hash covers; a landmark is every position with MASK bits of zero; how far from the landmark a
#: line end still wins over a nearer sentence end, and that over a nearer blank.
WINDOW, MASK, REACH = 24, 0xFF, 400

_SPACE = re.compile(r"\s")
_SOLID = re.compile(r"\S+")


def _mix(codes: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each code point."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def landmarks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind whose last WINDOW characters the hash has its low bits zero, and those hashes."""
    if len(codes) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    mixed = _mix(codes)
    rolled = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for back in range(WINDOW):  # the polynomial hash of every window at once
        rolled = rolled * np.uint64(0x100000001B3) + mixed[back : back + len(rolled)]
    rolled ^= rolled >> np.uint64(29)
    at = np.flatnonzero((rolled & np.uint64(MASK)) == 0)
    return at + WINDOW, rolled[at]


def boundaries(text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions after line ends, after sentences, after any white space; each includes the one before."""
    n = len(text)
    blank = np.zeros(n + 1, bool)
    blank[[m.end() for m in _SPACE.finditer(text)]] = True
    line = np.zeros(n + 1, bool)
    line[1:] = (codes == 10) | (codes == 13)
    line[1:n] &= ~((codes[:-1] == 13) & (codes[1:] == 10))  # a pair stays together
    if n:
        blank[1:n] &= ~((codes[:-1] == 13) & (codes[1:] == 10))
    sentence = line.copy()
    if n > 1:
        stop = np.isin(codes[:-1], (46, 33, 63, 59, 0x3002))
        sentence[2:] |= blank[2:] & stop
    return np.flatnonzero(line), np.flatnonzero(sentence), np.flatnonzero(blank)


def _nearest(places: np.ndarray, to: int, low: int, high: int) -> int | None:
    a, b = np.searchsorted(places, (low, high + 1))
    if a == b:
        return None
    k = int(np.searchsorted(places[a:b], to)) + a
    near = [int(places[i]) for i in (k - 1, k) if a <= i < b]
    return min(near, key=lambda p: (abs(p - to), p))


def cuts(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Where the pieces of a text end, and how: ``line``, ``sentence``, ``blank``, ``hard`` or ``end``."""
    n = len(text)
    if n <= max_chars:
        return [(n, "end")]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    marks, hashes = landmarks(codes)
    kinds = boundaries(text, codes)
    out, at = [], 0
    while n - at + (overlap if at else 0) > max_chars:
        room = max_chars - (overlap if at else 0)
        low, high = at + min(min_chars, room), at + room
        k, end = np.searchsorted(marks, (low, high + 1))
        mark = int(marks[k + int(hashes[k:end].argmin())]) if k < end else high
        cut = None
        for name, places in zip(("line", "sentence"), kinds, strict=False):
            cut = _nearest(places, mark, max(low, mark - REACH), min(high, mark + REACH))
            if cut is not None:
                break
        if cut is None:
            name, cut = "blank", _nearest(kinds[2], mark, low, high)
        if cut is None:  # rather a small piece than a cut inside a word
            cut = _nearest(kinds[2], low, max(at + 1, overlap), low - 1)
        if cut is None:  # unbroken text
            name, cut = "hard", mark
        out.append((cut, name))
        at = cut
    out.append((n, "end"))
    return out


def cut_run(text: str, found: list[tuple[int, str]]) -> int:
    """Most characters in a row without white space that a hard cut divides; 0 without hard cuts."""
    hard = [end for end, kind in found if kind == "hard"]
    if not hard:
        return 0
    runs = [(m.start(), m.end()) for m in _SOLID.finditer(text)]
    starts = np.array([a for a, _ in runs])
    return max(runs[k][1] - runs[k][0] for k in np.searchsorted(starts, hard) - 1)


_SCHEMA = pa.schema(
    [("id", pa.int64()), ("source_path", pa.string()), ("chunk_id", pa.int32()), ("piece_no", pa.int32()), ("first_char", pa.int32()), ("text", pa.string()), ("cut", pa.string()), ("hard", pa.int32())]
)


def split_chunks(chunks: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose content_text has more than ``max_chars`` characters.

    Pieces are numbered from 1 under id, source_path and chunk_id;
    ``first_char`` counts from 0 and lies ``overlap`` before the end of the
    piece before; dropping that overlap and joining gives the text again.
    ``hard`` says whether a hard cut divides a run without white space that no
    piece could hold (a run of more than ``max_chars`` always is).  Null, empty and fitting texts give no piece; repeated
    rows are split each; other columns are not read.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, path, chunk, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(rows) >= ROWS_PER_BATCH:
                    yield record_batch(rows, _SCHEMA)
                    rows = []
                found = cuts(text, max_chars, min_chars, overlap)
                hard, start = int(cut_run(text, found) > max_chars), 0
                for number, (end, kind) in enumerate(found, 1):
                    first = start - overlap if start else 0
                    rows.append((key, path, chunk, number, first, text[first:end], kind, hard))
                    start = end
            yield record_batch(rows, _SCHEMA)

    large = chunks.where(F.length("content_text") > max_chars).select("id", "source_path", F.col("chunk_id").cast("int").alias("chunk_id"), "content_text")
    return large.mapInArrow(split, "id bigint, source_path string, chunk_id int, piece_no int, first_char int, text string, cut string, hard int")


def rejoined(pieces: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Per chunk what its pieces amount to: id, n_chars and text_md5 of the text they join to, the longest piece, and where they end.

    Ids are unique; the pieces of one chunk meet in one row, as the chunk
    itself does.
    """
    piece = F.struct("piece_no", "first_char", "text")
    whole = pieces.groupBy("id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    fresh = F.transform("p", lambda x: F.when(x["piece_no"] == 1, x["text"]).otherwise(F.substring(x["text"], overlap + 1, 1_000_000_000)))
    text = F.array_join(fresh, "")
    # every piece begins the overlap before what the pieces before it have reached
    reached = F.array_max(F.transform("p", lambda x: x["first_char"] + F.length(x["text"])))
    return whole.select("id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"), F.array_max(F.transform("p", lambda x: F.length(x["text"]))).alias("longest"), reached.alias("reached"))


def found_large(chunks: DataFrame) -> DataFrame:
    """Chunks that were split and whether one of their runs had to be cut: (id, hard)."""
    return split_chunks(chunks).where("piece_no = 1").select("id", "hard")
