"""Deterministic folds and samples. Rows are ordered by a hash of their key, so partitioning doesn't matter.

Windows here are partitioned by stratum. Where one stratum may hold most rows, ranks come from `stratum_rank`, which counts in
two steps: within ranges of the hash, then ranges before one's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalars import lcg
from foldspark.operators.joins import join_nulls

#: Ranges of the hash, at least; more where there are more shuffle partitions.
RANGES = 256
#: Rows of a partition of a table that many passes read.
SHARE = 8192


def gathered(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, of some `rows` rows, in partitions of some SHARE rows, one for each core at least, each in order of the key.

    For tables that are kept for many passes: ranks leave a partition for each shuffle partition, and each pass costs a task for each.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHARE))
    return df.repartition(n, key).sortWithinPartitions(key)


def stratum_rank(df: DataFrame, stratum: list[str], key: str, name: str = "rank", seed: int = 42) -> DataFrame:
    """df with each row's rank (from 1) within its stratum in hash order.

    Sorting happens per (stratum, range of the hash), so a stratum with most rows is spread over all ranges; the offsets
    of ranges are sums over a table of strata times ranges. A null stratum is a stratum of its own, and a null key comes first.
    """
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    span = 2147483647 // ranges + 1
    df = df.withColumn("_hash", F.coalesce(lcg(F.col(key), seed), F.lit(0))).withColumn("_range", F.floor(F.col("_hash") / span).cast("int"))
    sizes = df.groupBy(*stratum, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*stratum, "_range").orderBy("_hash", key)
    out = join_nulls(df.withColumn("_within", F.row_number().over(within)), offsets, [*stratum, "_range"])
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_hash", "_range", "_before", "_within")


def folds(df: DataFrame, stratum: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """df with `fold` in 0..k-1: test sets part all rows, and a stratum's counts differ by one at most."""
    return stratum_rank(df, [stratum], key, "_rank", seed).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota): `total` shared in proportion to counts, remainders going to the largest fractions (ties: by name)."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    n = n.withColumn("all_n", F.sum("n").over(everything))
    n = n.withColumn("scaled", F.col("n") * F.least(F.lit(total), F.col("all_n")))
    n = n.withColumn("whole", F.floor(F.col("scaled") / F.col("all_n")).cast("long")).withColumn("rest", F.col("scaled") % F.col("all_n"))
    n = n.withColumn("left", F.least(F.lit(total), F.col("all_n")) - F.sum("whole").over(everything))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), stratum))
    return n.withColumn("place", place).select(stratum, (F.col("whole") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def subsample(df: DataFrame, stratum: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """A stratified sample of `total` rows; all rows, if there are no more."""
    q = quotas(df, stratum, total)
    return join_nulls(stratum_rank(df, [stratum], key, "_rank", seed), q, [stratum]).filter("_rank <= quota").drop("_rank", "quota")


def holdout(df: DataFrame, stratum: str, key: str, total: int, name: str = "held_out", seed: int = 42) -> DataFrame:
    """df with a flag that marks `total` rows, shared over strata in proportion to their counts."""
    r = join_nulls(stratum_rank(df, [stratum], key, "_rank", seed), quotas(df, stratum, total), [stratum])
    return r.withColumn(name, F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def top_groups(df: DataFrame, group: str, least: int, most: int) -> DataFrame:
    """(group, n) of at most `most` groups with `least` rows or more, by count, then by name."""
    return df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), group).limit(most)


def balanced(df: DataFrame, group: str, key: str, least: int, most: int, seed: int = 42) -> DataFrame:
    """Rows of the top groups, each cut to the size of the smallest; an error where no group has `least` rows."""
    top = top_groups(df, group, least, most)
    if top.isEmpty():
        raise ValueError(f"no {group} has {least} rows or more")
    size = top.agg(F.min("n").alias("_size"))
    kept = df.join(top.select(group), group, "left_semi")
    return stratum_rank(kept, [group], key, "_rank", seed).crossJoin(F.broadcast(size)).filter("_rank <= _size").drop("_rank", "_size")


def first_by_hash(df: DataFrame, condition: Column, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows that meet a condition, in hash order: a uniform sample without replacement, by a distributed top-n."""
    return df.filter(condition).orderBy(lcg(F.col(key), seed), key).limit(n)
