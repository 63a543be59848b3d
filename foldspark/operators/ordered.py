"""Running sums and ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.joins import join_nulls

#: Ranges of the order as a power of two, at least and at most; between, as many as there are shuffle partitions.
LEAST, MOST = 6, 14


def _below(bounds: str, x: str, power: int) -> Column:
    """How many of 2 ** power - 1 sorted bounds lie below x, by bisection."""
    steps = F.array(*[F.lit(1 << p) for p in range(power - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col(bounds), n + step - 1) < F.col(x), n + step).otherwise(n))


def running_sums(df: DataFrame, by: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """df with, for each name in `values`, the sum of its column over rows of the same `by` with a smaller or equal `order`.

    Rows of one `by` are spread over buckets of `order`, whose bounds are quantiles of the table, as many as there are shuffle
    partitions; a bucket's sums start from those of the buckets before it. Rows should be pre-aggregated to one for each (by, order).
    """
    power = min(MOST, max(LEAST, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    n = 1 << power
    bounds = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 20 * n).alias("_bounds"))
    df = df.crossJoin(F.broadcast(bounds))  # one row, at most 2 ** MOST values
    df = df.withColumn("_bucket", _below("_bounds", order, power)).drop("_bounds")
    totals = df.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    within = Window.partitionBy(*by, "_bucket").orderBy(order)
    df = join_nulls(df, totals, [*by, "_bucket"])
    return df.withColumns({n: F.col(f"_o_{n}") + F.sum(c).over(within) for n, c in values.items()}).drop("_bucket", *[f"_o_{n}" for n in values])


def rank_auc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """(*by, auc): area under the ROC curve by the rank statistic, ties counting half; null where a class is missing.

    `positive` is 0 or 1. Rows are first counted by distinct score.
    """
    p = F.col(positive).cast("long")
    counts = df.groupBy(*by, score).agg(F.sum(p).alias("_pos"), F.sum(1 - p).alias("_neg"))
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    r = running_sums(counts, keys, score, {"_below": "_neg"})
    wins = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2))
    out = r.groupBy(*keys).agg(F.try_divide(wins, F.sum("_pos") * F.sum("_neg")).alias("auc"))
    return out if by else out.select("auc")


def ks(df: DataFrame, by: list[str], value: str, in_sample: str) -> DataFrame:
    """(*by, ks): largest distance of the empirical distributions of rows with in_sample = 1 and of all rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_f"), F.sum(F.col(in_sample).cast("long")).alias("_s"))
    totals = df.groupBy(*by).agg(F.count("*").alias("_fn"), F.sum(F.col(in_sample).cast("long")).alias("_sn"))
    r = join_nulls(running_sums(counts, by, value, {"_cf": "_f", "_cs": "_s"}), totals, by)
    return r.groupBy(*by).agg(F.max(F.abs(F.try_divide("_cf", "_fn") - F.try_divide("_cs", "_sn"))).alias("ks"))


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, value, n, rank): the average rank of each distinct value, and how many rows have it."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    r = running_sums(counts, by, value, {"_upto": "n"})
    return r.select(*by, value, "n", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))
