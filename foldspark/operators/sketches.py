"""Mergeable states of distributions: KLL sketches with counts, sums and extremes, a row for each group of a chunk.

States of chunks add up to the state of the whole for any chunking, so tables that grow are described from stored states, without reading
rows again. Means, deviations and extremes of merged states are exact; a quantile's rank is off by less than `rank_error` of the rows with
99 % confidence, whatever the distribution, in a few kilobytes; sketches draw coins, so reruns may differ within that error. Exact quantiles (percentile) stay the default where rows are at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch.
K = 400
QUARTILES = (0.25, 0.5, 0.75)
_STATE = ("n", "s1", "s2", "least", "most", "sketch")


def rank_error(k: int = K) -> float:
    """Bound of the error of a single rank, a share of the rows, with 99 % confidence (the published fit for these sketches)."""
    return 2.296 / k**0.9723


def states(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """(*by, n, s1, s2, least, most, sketch) of a column's values; nulls and NaN are left out."""
    x = F.col(column).cast("double")
    some = df.filter(x.isNotNull() & ~F.isnan(x)).withColumn("_x", x)
    return some.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_x").alias("s1"), F.sum(F.col("_x") ** 2).alias("s2"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.kll_sketch_agg_double("_x", k).alias("sketch"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """States of the whole from states of its parts."""
    return parts.groupBy(*by).agg(*[f(c).alias(c) for c, f in zip(_STATE, (F.sum, F.sum, F.sum, F.min, F.max, F.kll_merge_agg_double), strict=True)])


def quantile(share: float) -> Column:
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))))


def describe(merged: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, mean, std, min, q25, q50, q75, max) from states alone."""
    n, mean = F.col("n"), F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") - F.col("s1") * mean, F.lit(0.0)) / F.when(n > 1, n - 1))
    return merged.select(*by, "n", mean.alias("mean"), spread.alias("std"), F.col("least").alias("min"), *[quantile(q).alias(f"q{round(100 * q)}") for q in QUARTILES], F.col("most").alias("max"))


def ks(a: DataFrame, b: DataFrame, by: list[str], points: int = 200) -> DataFrame:
    """(*by, n, m, ks, error): the two-sample distance of two states, and how far off it may be.

    Quantiles at `points` even shares stand for each distribution: how many of them lie at or below a value is its rank, within half
    a share. Ranks are compared at all quantiles of both sides.
    """
    shares = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    left = a.select(*by, F.col("n"), F.kll_sketch_get_quantile_double("sketch", shares).alias("_a"))
    right = b.select(*by, F.col("n").alias("m"), F.kll_sketch_get_quantile_double("sketch", shares).alias("_b"))
    j = left.join(right, by) if by else left.crossJoin(F.broadcast(right))  # a row each
    below = lambda q, x: F.size(F.filter(q, lambda v: v <= x))
    apart = F.transform(F.array_distinct(F.concat("_a", "_b")), lambda x: F.abs(below("_a", x) - below("_b", x)))
    return j.select(*by, "n", "m", (F.array_max(apart) / points).alias("ks"), F.lit(2 * rank_error() + 1 / points).alias("error"))
