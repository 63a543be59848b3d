"""Geometry of labelled rows: separability, centroids, drift of a sample, silhouettes. Features come as (row, feature, x) or arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.ordered import ks
from foldspark.operators.pairwise import matrix, pairs
from foldspark.operators.stats import ks_p, p_value


def class_moments(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, feature, n, mean, var): one scan, one row for each class and feature."""
    a = df.groupBy(label).agg(F.count("*").alias("n"), *[f(c).alias(f"{s}_{c}") for c in columns for s, f in (("m", F.avg), ("v", F.var_pop))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"v_{c}").alias("var")) for c in columns])
    return a.select(F.col(label).alias("label"), "n", F.explode(rows).alias("e")).select("label", "n", "e.*")


def fisher(moments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, fisher): squared distance of a class's mean from that of the rest, over the sum of both variances.

    The rest's moments follow from totals over classes; infinite where nothing varies.
    """
    keys = [*by, "feature"]
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    total = moments.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum(n * m).alias("all_1"), F.sum(n * (v + m * m)).alias("all_2"))
    j = moments.join(total, keys).filter(F.col("all_n") > n)
    rest = F.col("all_n") - n
    rest_mean = (F.col("all_1") - n * m) / rest
    rest_var = F.greatest((F.col("all_2") - n * (v + m * m)) / rest - rest_mean**2, F.lit(0.0))
    s = j.groupBy(*by, "label").agg(F.sum((m - rest_mean) ** 2).alias("between"), F.sum(v + rest_var).alias("within"))
    return s.select(*by, "label", F.when(F.col("within") > 0, F.try_divide("between", "within")).otherwise(F.lit(float("inf"))).alias("fisher"))


def centroid_distances(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(a, b, distance) for each ordered pair of classes."""
    m = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    a, b = m.select(F.col("label").alias("a"), "k", F.col("m").alias("ma")), m.select(F.col("label").alias("b"), "k", F.col("m").alias("mb"))
    return a.join(b, "k").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("ma") - F.col("mb")) ** 2)).alias("distance"))


def proportion_drift(full: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """One row: classes of either side, and the largest difference of their shares."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("label", (F.col("n") / F.col("all")).alias(name))

    j = shares(full, "f").join(shares(sample, "s"), "label", "full_outer").na.fill(0.0, ["f", "s"])
    return j.agg(F.count("*").alias("n_classes"), F.max(F.abs(F.col("f") - F.col("s"))).alias("max_abs_diff"))


def feature_drift(long: DataFrame, in_sample: str = "s") -> DataFrame:
    """One row from (feature, x, s): the largest shift of a mean in deviations, the largest relative change of a deviation, and
    how many features are constant in full and in the sample. Deviations of 0 count as 1 in the first and are left out in the second.
    """
    inside = F.when(F.col(in_sample) == 1, F.col("x"))
    a = long.groupBy("feature").agg(
        F.avg("x").alias("mf"), F.stddev_pop("x").alias("sf"), F.avg(inside).alias("ms"), F.stddev_pop(inside).alias("ss"),
        (F.max("x") == F.min("x")).alias("cf"), (F.max(inside) == F.min(inside)).alias("cs"))
    sd = F.when(F.col("cf"), F.lit(1.0)).otherwise(F.col("sf"))
    ratio = F.when(~F.col("cf"), F.abs(F.when(F.col("cs"), F.lit(0.0)).otherwise(F.col("ss")) / F.col("sf") - 1))
    return a.agg(
        F.max(F.abs(F.col("ms") - F.col("mf")) / sd).alias("max_mean_shift"), F.coalesce(F.max(ratio), F.lit(0.0)).alias("max_std_ratio_dev"),
        F.count_if("cf").alias("constant_full"), F.count_if("cs").alias("constant_sample"))


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """One row: the mean silhouette by Euclidean distance over all rows, from sums by row and class taken block by block.

    A row alone in its class counts 0.
    """

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(x[vector]), matrix(y[vector])
        dist = np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(2), 0)) if a.shape[1] <= 8 else np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
        own = x["_block"].iloc[0] == y["_block"].iloc[0]
        if own:  # rounding makes a row's distance from itself more than 0
            np.fill_diagonal(dist, 0)
        return by_class(x, y, dist) if own else pd.concat([by_class(x, y, dist), by_class(y, x, dist.T)])

    def by_class(x: pd.DataFrame, y: pd.DataFrame, dist: np.ndarray) -> pd.DataFrame:
        classes, code = np.unique(y[label].to_numpy(), return_inverse=True)
        sums = dist @ np.eye(len(classes))[code]
        return pd.DataFrame({"i": np.repeat(x[key].to_numpy(), len(classes)), "own": np.repeat(x[label].to_numpy(), len(classes)), "other": np.tile(classes, len(x)), "s": sums.ravel()})

    kind = dict(df.dtypes)[label]
    sums = pairs(df, df, key, run, f"i long, own {kind}, other {kind}, s double", symmetric=True).groupBy("i", "own", "other").agg(F.sum("s").alias("s"))
    n = df.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("n"))
    j = sums.join(n, "other")
    inner = F.max(F.when(F.col("own") == F.col("other"), F.try_divide("s", F.col("n") - 1)))
    outer = F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n")))
    r = j.groupBy("i").agg(inner.alias("a"), outer.alias("b"))
    return r.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def ks_reject_count(distances: DataFrame, level: float = 0.05) -> DataFrame:
    """One row from (feature, ks, n_full, n_sample): features, how many distances are significant, and how many chance alone would make."""
    p = p_value(lambda d, n, m: ks_p(d, int(n), int(m)), F.col("ks"), F.col("n_full"), F.col("n_sample"))
    d = distances.withColumn("p", p)
    return d.agg(F.count("*").alias("n_features"), F.count_if(F.col("p") < level).alias("n_reject"), (F.lit(level) * F.count("*")).alias("expected_rejects"))


def representativeness(df: DataFrame, label: str, columns: list[str], in_sample: str) -> DataFrame:
    """One row: how a sample (rows with in_sample = 1) differs from all rows, in class shares, moments, and distributions of features."""
    shares = proportion_drift(df, df.filter(F.col(in_sample) == 1), label)
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.col(in_sample).alias("s"), F.explode(each).alias("e")).select("s", "e.*")
    drift = feature_drift(long)
    sizes = df.agg(F.count("*").alias("n_full"), F.sum(F.col(in_sample).cast("long")).alias("n_sample"))
    rejects = ks_reject_count(ks(long, ["feature"], "x", "s").crossJoin(F.broadcast(sizes)))
    return shares.crossJoin(F.broadcast(drift)).crossJoin(F.broadcast(rejects)).crossJoin(F.broadcast(sizes))
