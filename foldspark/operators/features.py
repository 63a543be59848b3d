"""Feature transforms. Fits are aggregates over training rows, for all folds at once; applying them is a join with that small table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.joins import join_nulls


def fit_moments(df: DataFrame, columns: list[str], folds: int) -> DataFrame:
    """(fold, mean and population deviation of each column) over rows of all other folds.

    Counts, sums and sums of squares are taken once for each fold; those of the other folds are totals less one's own, so rows
    aren't repeated for each fold. Sums are of differences from a fixed row's value, which keeps them small.
    """
    base = df.agg(*[F.avg(c).alias(f"_base_{c}") for c in columns])
    x = df.crossJoin(F.broadcast(base))
    own = x.groupBy("fold").agg(F.count("*").alias("_n"), *[
        F.sum((F.col(c) - F.col(f"_base_{c}")) ** p).alias(f"_{c}_{p}") for c in columns for p in (1, 2)])
    names = ["_n", *[f"_{c}_{p}" for c in columns for p in (1, 2)]]
    total = own.agg(*[F.sum(n).alias(f"_all{n}") for n in names])
    rest = own.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(base)).filter(F.col("_all_n") > F.col("_n")).filter(F.col("fold") < folds)
    n = F.col("_all_n") - F.col("_n")
    out = ["fold"]
    for c in columns:
        m1, m2 = (F.col(f"_all_{c}_{p}") - F.col(f"_{c}_{p}") for p in (1, 2))
        out += [(m1 / n + F.col(f"_base_{c}")).alias(f"{c}_mean"), F.sqrt(F.greatest(m2 / n - (m1 / n) ** 2, F.lit(0.0))).alias(f"{c}_std")]
    return rest.select(*out)


def standardize(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """df with *_z: mean 0 and population deviation 1 on training rows; a constant column is divided by 1."""
    j = df.join(F.broadcast(fit), "fold")  # a row for each fold
    return j.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(F.lit(1.0)) for c in columns})


def greedy_kept(r: np.ndarray, threshold: float) -> np.ndarray:
    """Which columns stay: each in turn drops all later ones whose correlation with it is above the threshold, unless it is dropped.

    Order matters, so this runs on the driver, over a matrix of columns times columns.
    """
    kept = np.ones(len(r), bool)
    for i in range(len(r)):
        if kept[i]:
            kept[i + 1 :] &= ~(np.abs(r[i, i + 1 :]) > threshold)
    return kept


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight = rows / (classes * rows of the class). Class counts are joined, so a large class isn't gathered; null is a class."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    n = n.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return join_nulls(df, n, [label])


def to_vector(record: str, fields: list[str]) -> Column:
    return F.array(*[F.col(f"{record}.{f}").cast("double") for f in fields])


def map_tokens(m: str) -> list[Column]:
    """`names`: distinct lower-case keys; `tokens`: lower-case key:value for every value."""
    names = F.array_distinct(F.transform(F.map_keys(m), F.lower)).alias("names")
    tokens = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda v: F.concat(F.lower(e["key"]), F.lit(":"), v)))).alias("tokens")
    return [names, tokens]


def interleave(pairs: str, n: int) -> Column:
    """a0, b0, a1, b1, ... of the first n pairs, zeros where there are fewer."""
    at = lambda i: F.get(F.col(pairs), i)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(F.coalesce(at(i)["a"], F.lit(0.0)), F.coalesce(at(i)["b"], F.lit(0.0)))))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(fold, i, n, s, products): for each fold and column, the fold's rows, the sum of the column, and of its products with all columns.

    One scan: each task adds up matrices of its rows, a fold's in columns times columns, and sends them by (fold, column).
    """
    d = len(columns)
    rows = df.select(F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(len(b)), *[b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)]])
            fold = b.column(0).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                mine = x[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + mine.T @ mine
        for f, p in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(np.full(d, p[0, 0])), pa.array(p[0, 1:].copy()), pa.array([r.tobytes() for r in p[1:, 1:]], pa.binary())],
                ["fold", "i", "n", "s", "products"])

    def total(t: pa.Table) -> pa.Table:
        p = sum(np.frombuffer(x.as_buffer()) for x in t.column("products").combine_chunks())
        return pa.table({
            "fold": t.column("fold")[:1], "i": t.column("i")[:1], "n": pa.array([t.column("n").to_numpy().sum()]), "s": pa.array([t.column("s").to_numpy().sum()]),
            "products": pa.array([p.tobytes()], pa.binary())})

    ddl = "fold int, i int, n double, s double, products binary"
    return rows.mapInArrow(add, ddl).groupBy("fold", "i").applyInArrow(total, ddl)


class Chain:
    """Variance filter, greedy correlation filter, standardisation and principal components, fitted for every fold at once.

    The fit of a fold comes from the sums of all other folds, in one scan of the rows; what is left (a matrix of columns times columns
    for each fold) is reduced on the driver, and a fold's transform is a small matrix that is joined to its rows. Rows have no nulls.
    """

    def __init__(self, df: DataFrame, columns: list[str], components: int, correlation: float = 0.95, variance: float = 0.0):
        d = len(columns)
        own: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
        for r in moments(df, columns).collect():  # a row for each fold and column
            _, s, p = own.setdefault(r["fold"], (r["n"], np.zeros(d), np.zeros((d, d))))
            s[r["i"]] = r["s"]
            p[r["i"]] = np.frombuffer(r["products"])
        total = [sum(o[i] for o in own.values()) for i in range(3)]
        self.columns, self.fits = columns, {}
        for fold, (n, s, p) in sorted(own.items()):
            m = total[0] - n
            if m <= 0:
                continue
            mean = (total[1] - s) / m
            cov = (total[2] - p) / m - np.outer(mean, mean)
            var = np.maximum(cov.diagonal(), 0)
            varies = var > np.maximum(variance, 1e-12 * (mean**2 + 1))
            r = cov / np.sqrt(np.outer(np.where(varies, var, 1), np.where(varies, var, 1)))
            kept = np.flatnonzero(varies)
            kept = kept[greedy_kept(r[np.ix_(kept, kept)], correlation)]
            if components > len(kept):
                raise ValueError(f"{components} components of {len(kept)} features")
            values, axes = np.linalg.eigh(r[np.ix_(kept, kept)])
            order = np.argsort(-values)[:components]
            axes = axes[:, order] * np.sign(axes[np.argmax(np.abs(axes[:, order]), 0), order])
            matrix = np.zeros((components, d))
            matrix[:, kept] = axes.T / np.sqrt(var[kept])
            self.fits[fold] = {"kept": [columns[i] for i in kept], "explained": (values[order] / max(len(kept), 1)).tolist(), "matrix": matrix, "mean": mean}

    def transform(self, df: DataFrame) -> DataFrame:
        """df with z, the components of each row by its fold's fit, and explained, their shares of the variance."""
        rows = [(f, v["matrix"].tolist(), v["mean"].tolist(), v["explained"]) for f, v in self.fits.items()]
        fits = df.sparkSession.createDataFrame(rows, "fold int, _m array<array<double>>, _mean array<double>, explained array<double>")
        j = df.join(F.broadcast(fits), "fold")  # a row for each fold
        x = F.zip_with(F.array(*[F.col(c).cast("double") for c in self.columns]), F.col("_mean"), lambda a, b: a - b)
        dot = lambda row: F.aggregate(F.zip_with(row, F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return j.withColumn("_x", x).withColumn("z", F.transform("_m", dot)).drop("_m", "_mean", "_x")


def stitch(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables side by side, joined by a key that each has once; an error where they share another column."""
    out = parts[0]
    for p in parts[1:]:
        if twice := sorted((set(out.columns) & set(p.columns)) - {key}):
            raise ValueError(f"columns in several tables: {', '.join(twice)}")
        out = out.join(p, key)
    return out
