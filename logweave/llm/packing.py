"""Filling fixed-capacity containers: sum-of-squares packing.

N(g) counts the open bins with gap g.  An item goes where the sum of the
squares of these counts becomes smallest: into a bin of some gap, or into a
new one.  That keeps gaps of all sizes in stock and so wastes little.

Every partition packs its own items.  The bins that stay open then meet in a
second round as items themselves, so that small partitions waste no more than
large ones; nothing but open bins is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.tokenizer import VOCABULARY, count_tokens
from logweave.session import ensure_checkpoint_dir

CAPACITY = 2048
#: Open bins that one task of the second round takes.
BINS_PER_TASK = 50_000


class SumOfSquares:
    """An online packer: ``place(size)`` names the bin of the next item."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.gaps = np.zeros(capacity + 1, np.int64)  # N(g); N(0) stays 0
        self.open: dict[int, list[int]] = {}
        self.bins = 0

    def place(self, size: int) -> int:
        counts, capacity = self.gaps, self.capacity
        # change of the sum of squares when an item leaves gap g for gap g - size
        change = 2 * (counts[: capacity + 1 - size] - counts[size:]) + 2
        change[0] -= 2 * counts[0] + 1  # a full bin is closed
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        rest = capacity - size
        fresh = 2 * int(counts[rest]) + 1 if rest else 0
        if change[best] > fresh:
            gap, bin_no = capacity, self.bins
            self.bins += 1
        else:
            gap = best + size
            stack = self.open[gap]
            bin_no = stack.pop()
            self.gaps[gap] -= 1
        left = gap - size
        if left:
            self.gaps[left] += 1
            self.open.setdefault(left, []).append(bin_no)
        return bin_no


def _local(items: DataFrame, capacity: int) -> DataFrame:
    """(item_id, part_no, size, bin_no) with bin numbers unique over partitions; whole parts of oversized items first."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, offset = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for key, size in zip(batch["item_id"].tolist(), batch["size"].tolist(), strict=True):
                part = 0
                while size > capacity:
                    rows.append((key, part, capacity, offset + packer.place(capacity)))
                    size -= capacity
                    part += 1
                if size:
                    rows.append((key, part, size, offset + packer.place(size)))
                else:  # takes no room anywhere
                    rows.append((key, part, 0, offset + max(0, packer.bins - 1)))
            yield pd.DataFrame(rows, columns=["item_id", "part_no", "size", "bin_no"])

    return items.select("item_id", "size").mapInPandas(pack, "item_id bigint, part_no int, size int, bin_no bigint")


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item_id, part_no, size, bin_no): every item in one bin, an oversized one in several.

    ``items``: item_id, size (null counts as 0).  An item over the capacity is
    split into parts of the capacity and a rest; no other is split.  Items of
    no size stand in some bin.  Bins that are not full after round one are
    packed again as items; no items give no bins.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    clean = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("size", F.lit(0)).cast("int").alias("size"))
    first = _local(clean, capacity).checkpoint()
    filled = first.groupBy("bin_no").agg(F.sum("size").cast("int").alias("size"))
    partial = filled.where(F.col("size") < capacity)
    tasks = max(1, -(-partial.count() // BINS_PER_TASK))
    # large bins first: what remains open is then filled by the small ones
    again = partial.select(F.col("bin_no").alias("item_id"), "size").repartition(tasks, "item_id").sortWithinPartitions(F.desc("size"), "item_id")

    def repack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        offset, gaps, bins = (1 << 62) + (part << 40), {}, 0
        largest: list[int] = []
        for batch in batches:
            rows = []
            for key, size in zip(batch["item_id"].tolist(), batch["size"].tolist(), strict=True):
                at = np.searchsorted(largest, size) if largest else 0
                if largest and at < len(largest):  # the tightest gap that takes it
                    gap = largest[at]
                    bin_no = gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap]
                        largest.pop(at)
                else:
                    gap, bin_no = capacity, bins
                    bins += 1
                left = gap - size
                if left:
                    if left not in gaps:
                        gaps[left] = []
                        largest.insert(int(np.searchsorted(largest, left)), left)
                    gaps[left].append(bin_no)
                rows.append((key, offset + bin_no))
            yield pd.DataFrame(rows, columns=["bin_no", "joined"])

    moved = again.mapInPandas(repack, "bin_no bigint, joined bigint")
    return first.join(moved, "bin_no", "left").select("item_id", "part_no", "size", F.coalesce("joined", "bin_no").alias("bin_no"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents, sized in tokens, in containers: (doc_id, part_no, n_tokens, bin_no)."""
    sized = count_tokens(documents, vocabulary).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))
    return pack_items(sized, capacity).select(F.col("item_id").alias("doc_id"), "part_no", F.col("size").alias("n_tokens"), "bin_no")
