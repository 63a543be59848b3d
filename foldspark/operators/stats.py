"""Paired tests: statistics as aggregates, p-values as columns of the rows that are left, one for each group."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.joins import join_nulls
from foldspark.operators.ordered import average_ranks


def ttest_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    m = df.select(d.alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return m.select("n", "mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("t"))


def wilcoxon_statistic(df: DataFrame, difference: str) -> DataFrame:
    """One row: W+, W- and their minimum, zero differences left out, ties with average ranks."""
    d = df.filter(F.col(difference) != 0).select(F.col(difference).alias("_d"), F.abs(difference).alias("_size"), F.lit(0).alias("_all"))
    signs = d.groupBy("_size").agg(F.count_if(F.col("_d") > 0).alias("_plus"), F.count_if(F.col("_d") < 0).alias("_minus"))
    r = average_ranks(d, ["_all"], "_size").join(signs, "_size")
    w = r.agg(F.sum(F.col("rank") * F.col("_plus")).alias("w_plus"), F.sum(F.col("rank") * F.col("_minus")).alias("w_minus"))
    return w.withColumn("w", F.least("w_plus", "w_minus"))


def mcnemar_counts(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: n01 (only b is right), n10 (only a is right) and the smaller of both."""
    right_a, right_b = F.col(a) == F.col(y), F.col(b) == F.col(y)
    c = df.agg(F.count_if(~right_a & right_b).alias("n01"), F.count_if(right_a & ~right_b).alias("n10"))
    return c.withColumn("statistic", F.least("n01", "n10"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):  # some roots of a or b steps are enough
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def ttest_p(t: float, n: int) -> float:
    """Two-sided p-value of a paired t statistic over n pairs."""
    return betainc((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


#: Differences up to which the signed-rank test is exact.
EXACT = 25


def signed_rank_p(w: float, ties: Sequence[tuple[int, int]]) -> float:
    """Exact two-sided p-value of the lesser rank sum, from (doubled rank, how many differences have it): ranks of ties are halves.

    Each difference's sign is a fair coin; the sums that signs can give are counted rank by rank.
    """
    n, top = sum(c for _, c in ties), sum(r * c for r, c in ties)
    ways = np.zeros(top + 1)
    ways[0] = 1
    for rank, count in ties:
        for _ in range(count):
            ways[rank:] += ways[:-rank].copy()
    return min(1.0, 2 * float(ways[: math.floor(2 * w + 1e-9) + 1].sum()) / 2.0**n)


def wilcoxon_p(w: float, n: int, ties: Sequence[tuple[int, int]] | None = None) -> float:
    """Two-sided p-value: exact for up to EXACT differences, by their ranks (without: 1 to n), else the normal approximation."""
    if n == 0:
        return 1.0
    if n <= EXACT:
        return signed_rank_p(w, ties or [(2 * r, 1) for r in range(1, n + 1)])
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def mcnemar_p(n01: int, n10: int) -> float:
    """Exact two-sided p-value: a fair coin over the disagreements, whose tail is an incomplete beta function."""
    n, k = n01 + n10, min(n01, n10)
    return 1.0 if 2 * k >= n else min(1.0, 2 * betainc(n - k, k + 1, 0.5))


def ks_p(statistic: float, n: int, m: int) -> float:
    """Asymptotic p-value of a two-sample distance."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def p_value(f: Callable[..., float], *columns: Column) -> Column:
    """The p-value of a test as a column, null where a value that it takes is null."""

    @F.pandas_udf("double")
    def each(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in frame.itertuples(index=False)], dtype="float64")

    return each(F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))


def _rank_p(w: Column, n: Column, ranks: str) -> Column:
    @F.pandas_udf("double")
    def each(w: pd.Series, n: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(float(a), int(b), None if c is None else [(int(x["rank"]), int(x["count"])) for x in c]) for a, b, c in zip(w, n, ranks, strict=True)], dtype="float64")

    return each(w, n, F.col(ranks))


def significant(p: Column, level: float = 0.05) -> Column:
    """Whether a p-value is below the level; null without one, as for a pair that was skipped."""
    return F.when(p.isNotNull() & ~F.isnan(p), p < level)


def paired_tests(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(*by, n, mean_a, mean_b, delta, t, ttest_p, ttest_significant, w, wilcoxon_p) of paired scores in each group, in two aggregates."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    m = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg("_d").alias("_mean"), F.stddev_samp("_d").alias("_sd"))
    m = m.withColumn("t", F.try_divide(F.col("_mean"), F.col("_sd") / F.sqrt("n")))
    r = average_ranks(d.filter("_d <> 0").withColumn("_size", F.abs("_d")), by, "_size").withColumnRenamed("n", "_ties")
    signs = d.filter("_d <> 0").groupBy(*by, F.abs("_d").alias("_size")).agg(F.count_if(F.col("_d") > 0).alias("_plus"), F.count_if(F.col("_d") < 0).alias("_minus"))
    w = join_nulls(r, signs, [*by, "_size"]).groupBy(*by).agg(F.sum(F.col("rank") * F.col("_plus")).alias("_wp"), F.sum(F.col("rank") * F.col("_minus")).alias("_wm"), F.sum("_ties").alias("_nonzero"))
    few = w.filter(F.col("_nonzero") <= EXACT).select(*by)  # only groups of few differences list their ranks
    pair = F.struct((2 * F.col("rank")).cast("long").alias("rank"), F.col("_ties").cast("long").alias("count"))
    ranks = join_nulls(r, few, by).groupBy(*by).agg(F.sort_array(F.collect_list(pair)).alias("_ranks"))
    j = join_nulls(join_nulls(m, w, by, "left"), ranks, by, "left").withColumn("w", F.least("_wp", "_wm"))
    j = j.withColumn("ttest_p", p_value(lambda t, n: ttest_p(t, int(n)) if n > 1 else math.nan, F.col("t"), F.col("n")))
    j = j.withColumn("wilcoxon_p", _rank_p(F.coalesce("w", F.lit(0.0)), F.coalesce("_nonzero", F.lit(0)), "_ranks"))
    return j.select(*by, "n", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), "t", "ttest_p", significant(F.col("ttest_p")).alias("ttest_significant"), "w", "wilcoxon_p")


def mcnemar(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """(*by, n, n01, n10, statistic, pvalue, significant) of two predictions in each group; null p-values where nothing is shared."""
    right_a, right_b = F.col(a) == F.col(y), F.col(b) == F.col(y)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    c = df.groupBy(*by).agg(F.count_if(both).alias("n"), F.count_if(both & ~right_a & right_b).alias("n01"), F.count_if(both & right_a & ~right_b).alias("n10"))
    p = p_value(lambda x, z: mcnemar_p(int(x), int(z)), *[F.when(F.col("n") > 0, F.col(k)) for k in ("n01", "n10")])
    c = c.withColumn("statistic", F.least("n01", "n10")).withColumn("pvalue", p)
    return c.withColumn("significant", significant(F.col("pvalue")))
