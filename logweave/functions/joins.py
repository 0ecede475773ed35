"""Joins with small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(side: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``side`` with a broadcast hint if it has no more than ``most_rows`` rows, else as it is.

    Only so many rows and one more are counted.  Meant for dimensions of a
    few narrow columns.
    """
    rows = side.select(F.lit(1)).limit(most_rows + 1).count()
    return F.broadcast(side) if rows <= most_rows else side


def salted(facts: DataFrame, side: DataFrame, keys: list[str], salt: str, parts: int = 16, how: str = "left") -> DataFrame:
    """A join of ``facts`` with a side of few rows for each key, where one key may hold a large part of the facts.

    The side is repeated ``parts`` times and the facts spread by a hash of the
    column ``salt``, so that a hot key meets in ``parts`` tasks.
    """
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = facts.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")
