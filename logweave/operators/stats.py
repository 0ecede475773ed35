"""Repeated-run statistics, histograms, distributions and the paired signed-rank test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.prefix import running_sum


def bin_of(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Bin from 1 to ``bins`` of equal width; the highest value lies in the last."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(F.width_bucket(value, low, high, F.lit(bins)), F.lit(bins))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the least and the greatest value: (bin, n); empty bins have no row."""
    low, high = values.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()  # two numbers
    rows = values.where(F.col(column).isNotNull())
    placed = F.lit(1) if low is None or low == high else bin_of(F.col(column).cast("double"), low, high, bins)
    return rows.select(placed.cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def histogram_outlier(values: DataFrame, column: str, width: float, highest: float) -> DataFrame:
    """Bins of a fixed width up to ``highest`` and one bin, -1, for all beyond."""
    placed = F.when(F.col(column) > highest, -1).otherwise(F.floor(F.col(column) / width))
    return values.where(F.col(column).isNotNull()).select(placed.cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def distribution(values: DataFrame, column: str, width: float = 1000.0) -> DataFrame:
    """Per distinct value the shares at most and at least so large: (value, cdf, ccdf).

    Values are counted first; the running sum is made in blocks of ``width``.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    upto = running_sum(counts.withColumn("all", F.lit(0)), ["all"], "value", "n", width, name="upto")
    share = lambda c: F.round(c / F.lit(float(total)), 9)
    return upto.select("value", share(F.col("upto")).alias("cdf"), share(F.lit(total) - F.col("upto") + F.col("n")).alias("ccdf"))


def run_statistics(values: DataFrame) -> DataFrame:
    """Per sample over its runs (run, sample, value): mean, variance, deviation, extremes; one run has variance 0."""
    return values.groupBy("sample").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.var_samp("value"), F.lit(0.0)), 6).alias("variance"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"),
    )


def overall_statistics(values: DataFrame) -> DataFrame:
    """Mean of means, variance of means, mean variance within samples."""
    per = values.groupBy("sample").agg(F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))
    return per.agg(F.count("*").alias("n_samples"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.var_samp("mean"), 6).alias("variance_of_means"), F.round(F.avg("variance"), 6).alias("variance_within"))


def compare(pairs: DataFrame) -> DataFrame:
    """Paired values (group, before, after): how many improved, stayed, worsened, and the mean change."""
    d = F.col("after") - F.col("before")
    return pairs.groupBy("group").agg(F.count_if(d > 0).alias("improved"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("worsened"), F.round(F.avg(d), 6).alias("mean_change"))


def _exact_p(statistic: float, n: int) -> float:
    """Two-sided p of the signed-rank statistic from the number of sign patterns."""
    most = n * (n + 1) // 2
    ways = [1] + [0] * most
    for rank in range(1, n + 1):
        for s in range(most, rank - 1, -1):
            ways[s] += ways[s - rank]
    return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)


def signed_rank(differences: list[float], exact_up_to: int = 50) -> tuple[float, float]:
    """Wilcoxon signed-rank test: statistic and two-sided p.

    Zeros are dropped; equal sizes share the mean rank.  Without ties and
    zeros p is exact up to ``exact_up_to`` pairs, else by the normal
    approximation with tie correction.  No differences give (0, 1).
    """
    sizes = sorted(((abs(d), d > 0) for d in differences if d), key=lambda x: x[0])
    n = len(sizes)
    if not n:
        return 0.0, 1.0
    plus = minus = ties = 0.0
    i = 0
    while i < n:
        j = i
        while j < n and sizes[j][0] == sizes[i][0]:
            j += 1
        rank, same = (i + 1 + j) / 2, j - i
        ties += same**3 - same
        for k in range(i, j):
            if sizes[k][1]:
                plus += rank
            else:
                minus += rank
        i = j
    statistic = min(plus, minus)
    if not ties and n == len(differences) and n <= exact_up_to:
        return statistic, _exact_p(statistic, n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (statistic - n * (n + 1) / 4) / spread
    return statistic, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def signed_rank_by_group(pairs: DataFrame) -> DataFrame:
    """(group, n, statistic, p) of paired values; a group holds the samples of one experiment."""

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        differences = (frame["after"] - frame["before"]).tolist()
        return pd.DataFrame([(frame["group"].iloc[0], len(differences), *signed_rank(differences))], columns=["group", "n", "statistic", "p"])

    kind = dict(pairs.dtypes)["group"]
    return pairs.select("group", "before", "after").groupBy("group").applyInPandas(test, f"group {kind}, n bigint, statistic double, p double")


def min_max(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``scaled`` to 0..1 within keys; 0.5 where all are equal."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")))
    return rows.join(ends, keys).withColumn("scaled", F.round(scaled, 9)).drop("low", "high")


