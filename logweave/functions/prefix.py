"""Running sums and ranks of ordered groups without gathering a group in one task.

Rows are cut into blocks of their order column.  Sums per block are made
first (by partial aggregation) and only they pass through a window over the
whole group; rows are sorted within their block alone.  A group of any size is
spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, keys: list[str], order: str, values: dict[str, str], width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """For each ``name: column`` of ``values`` the sum of the column over the rows of the same keys up to and with this one.

    ``order`` is a number column without nulls, ``width`` the size of a block
    of it; rows of equal order follow ``ties``, else any order.  Null values
    add nothing.
    """
    block = "__block"
    parted = rows.withColumn(block, F.floor(F.col(order) / F.lit(width)))
    sums = parted.groupBy(*keys, block).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__sum_{n}") for n, c in values.items()])
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, block, *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in values])
    upto = W.partitionBy(*keys, block).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = parted.withColumns({f"__local_{n}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in values.items()})
    joined = local.join(starts, [*keys, block]).withColumns({n: F.col(f"__before_{n}") + F.col(f"__local_{n}") for n in values})
    return joined.drop(block, *[f"__{kind}_{n}" for n in values for kind in ("local", "before")])


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, width: int, ties: tuple[str, ...] = (), name: str = "running") -> DataFrame:
    return running_sums(rows, keys, order, {name: value}, width, ties)


def ranked(rows: DataFrame, keys: list[str], order: str, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``rank`` from 1 of every row within its keys."""
    return running_sum(rows.withColumn("__one", F.lit(1)), keys, order, "__one", width, ties, "rank").drop("__one")
