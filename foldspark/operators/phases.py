"""Sums over all pairs of kernels of the difference of two numbers, from sums of phases: linear in rows, and no pair is ever met.

The sum of cos(w * (x - y)) over all pairs, a row with itself included, is |sum of exp(i w x)|^2. The one-qubit IQP kernel is
(1 + cos(b (x - y))) / 2 and its square (3 + 4 cos(b (x - y)) + cos(2 b (x - y))) / 8. A Gaussian is such a sum, too: by the trapezoidal
rule on its Fourier integral, exp(-g t^2) = sum of c_k cos(k h t), where the rule's error is the Gaussian's own value at 2 pi / h - |t|.
With h from the spread of x and k up to where c_k vanishes, both errors are below EXACT: the rounding of doubles. That takes some
2 * (spread / width + 6) phases; the spread is at most some 2 * sqrt(rows) deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: -log of the error of a Gaussian; values times phases that a task holds at once.
EXACT, CELLS = 37.0, 1 << 21


def gaussian_phases(gamma: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and coefficients of exp(-gamma * t * t) for |t| up to spread."""
    h = 2 * np.pi / (spread + np.sqrt(EXACT / gamma))
    w = h * np.arange(int(np.sqrt(4 * gamma * EXACT) / h) + 2)
    c = h / np.sqrt(np.pi * gamma) * np.exp(-(w**2) / (4 * gamma))
    return w, np.where(w == 0, c / 2, c)


def squares(rows: DataFrame, value: str, frequencies: np.ndarray, coefficients: np.ndarray, middle: float = 0.0) -> DataFrame:
    """One row (total): the sum over all ordered pairs, a row with itself included, of sum_k c_k cos(w_k (x - y)). Null values are no rows."""
    n = len(frequencies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros(n, complex)
        for b in batches:
            x, step = b["x"].to_numpy() - middle, max(1, CELLS // n)
            for lo in range(0, len(x), step):
                s += np.exp(1j * x[lo : lo + step, None] * frequencies).sum(0)
        yield pd.DataFrame({"k": np.arange(n), "c": coefficients, "re": s.real, "im": s.imag})

    x = rows.select(F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    sums = x.mapInPandas(run, "k long, c double, re double, im double").groupBy("k", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return sums.agg(F.sum(F.col("c") * (F.col("re") ** 2 + F.col("im") ** 2)).alias("total"))


def gaussian_sums(rows: DataFrame, value: str, gamma: float) -> DataFrame:
    """One row (n, k1, k2) of sums over pairs i < j of exp(-gamma * (x - y)^2)."""
    of = rows.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    n, lo, hi = of["n"], of["lo"] or 0.0, of["hi"] or 0.0
    each = [squares(rows, value, *gaussian_phases(g, hi - lo), (hi + lo) / 2).select(((F.coalesce("total", F.lit(0.0)) - n) / 2).alias(c)) for g, c in ((gamma, "k1"), (2 * gamma, "k2"))]
    return each[0].crossJoin(each[1]).select(F.lit(n * (n - 1) // 2).cast("long").alias("n"), "k1", "k2")


def iqp_sums(rows: DataFrame, value: str, label: str, bandwidths: tuple[float, ...]) -> DataFrame:
    """(bandwidth, n, k1, k2, same) over pairs i < j, as kernels.kernel_sums has them for the one-qubit IQP kernel. Null labels are equal to none."""
    x = rows.select(F.col(value).cast("double").alias("x"), F.col(label).alias("y")).filter("x IS NOT NULL")
    names = [(f"{p}{k}_{m}", g(F.col("x") * (b * m))) for k, b in enumerate(bandwidths) for m in (1, 2) for p, g in (("c", F.cos), ("s", F.sin))]
    by = x.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(e).alias(c) for c, e in names])
    size = lambda c, k, m: c(f"c{k}_{m}") ** 2 + c(f"s{k}_{m}") ** 2
    same = [F.sum(F.when(F.col("y").isNotNull(), ((F.col("n") * F.col("n") + size(F.col, k, 1)) / 2 - F.col("n")) / 2)).alias(f"same{k}") for k in range(len(bandwidths))]
    one = by.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c, _ in names], *same)
    n = F.col("n").cast("double")
    each = [F.struct(F.lit(b).alias("bandwidth"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"), (((n * n + size(F.col, k, 1)) / 2 - n) / 2).alias("k1"),
                     ((n * n * 3 / 8 + size(F.col, k, 1) / 2 + size(F.col, k, 2) / 8 - n) / 2).alias("k2"), F.coalesce(f"same{k}", F.lit(0.0)).alias("same")) for k, b in enumerate(bandwidths)]
    return one.select(F.explode(F.array(*each)).alias("e")).select("e.*")
