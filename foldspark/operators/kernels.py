"""Fidelity kernels from states prepared once for each row, Gram tables by blocks, and their diagnostics.

The state of a row under a feature map has 2 ** q amplitudes; the kernel is the squared size of the inner product. That is
n preparations and n * n inner products, not n * n simulated circuits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.pairwise import BLOCK, matrix, pairs

#: Values that files pack at a time, a multiple of which a repeated run has; and values of a run: fast codecs miss copies after longer ones.
PACKED, RUN = 8, 64


def _bits(n: int) -> np.ndarray:
    """All bit strings of n, the first qubit most significant."""
    return (np.arange(1 << n)[:, None] >> np.arange(n - 1, -1, -1)) & 1


def states(x: np.ndarray, encoding: str, bandwidth: float = 1.0) -> np.ndarray:
    """A row of amplitudes for each row of x."""
    if encoding == "amplitude":
        width = 1 << max(1, int(np.ceil(np.log2(max(1, x.shape[1])))))
        padded = np.zeros((len(x), width))
        padded[:, : x.shape[1]] = x
        norm = np.linalg.norm(padded, axis=1, keepdims=True)
        return padded / np.where(norm > 0, norm, 1)
    n = x.shape[1]
    y, bits = bandwidth * x, _bits(n)
    if encoding == "angle":  # RY on each qubit, a chain of CNOT, RZ on each
        half = y[:, None, :] / 2
        size = np.prod(np.where(bits[None] == 0, np.cos(half), np.sin(half)), axis=2)
        after = np.bitwise_xor.accumulate(bits, axis=1)
        phase = np.exp(-0.5j * (y @ (1 - 2 * after).T))
        out = np.empty((len(x), 1 << n), complex)
        out[:, after @ (1 << np.arange(n - 1, -1, -1))] = size * phase
        return out
    if encoding == "iqp":  # H on each qubit, RZ on each, ZZ on each pair
        z = 1 - 2 * bits
        i, j = np.triu_indices(n, 1)
        angle = y @ z.T + (y[:, i] * y[:, j]) @ (z[:, i] * z[:, j]).T
        return np.exp(-0.5j * angle) / 2 ** (n / 2)
    raise ValueError(f"unknown encoding: {encoding}")


def fidelity(a: np.ndarray, b: np.ndarray, encoding: str, bandwidth: float = 1.0) -> np.ndarray:
    return np.abs(states(a, encoding, bandwidth).conj() @ states(b, encoding, bandwidth).T) ** 2


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def gram(a: DataFrame, b: DataFrame, kernel: Kernel, key: str = "i", vector: str = "x", block: int = BLOCK) -> DataFrame:
    """(i, j, k) for every row i of a and j of b."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        k = kernel(matrix(x[vector]), matrix(y[vector]))
        return pd.DataFrame({"i": np.repeat(x[key].to_numpy(), len(y)), "j": np.tile(y[key].to_numpy(), len(x)), "k": k.ravel()})

    return pairs(a, b, key, run, "i long, j long, k double", block=block, widest=BLOCK)


def gram_upper(a: DataFrame, kernel: Kernel, key: str = "i", vector: str = "x", block: int = BLOCK, mirrored: bool = False) -> DataFrame:
    """(i, j, k) for i < j: half of the symmetric table, whose diagonal is 1. mirrored: both halves, each kernel taken once."""

    def both(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> pd.DataFrame:
        # a row's kernels, then at once the same ones mirrored: columnar files write the second run as a copy of the first
        a, b = np.broadcast_to(x[:, None], k.shape), np.broadcast_to(y, k.shape)
        return pd.DataFrame({"i": np.stack([a, b], 1).ravel(), "j": np.stack([b, a], 1).ravel(), "k": np.stack([k, k], 1).ravel()})

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        k = kernel(matrix(x[vector]), matrix(y[vector]))
        if mirrored and x["_block"].iloc[0] != y["_block"].iloc[0]:
            cut = len(y) - len(y) % PACKED
            ends = [*range(0, cut, RUN), cut, len(y)]
            return pd.concat([both(x[key].to_numpy(), y[key].to_numpy()[lo:hi], k[:, lo:hi]) for lo, hi in zip(ends, ends[1:])], ignore_index=True)
        i, j = np.repeat(x[key].to_numpy(), len(y)), np.tile(y[key].to_numpy(), len(x))
        keep = i < j if x["_block"].iloc[0] == y["_block"].iloc[0] else np.ones(len(i), bool)
        i, j, k = i[keep], j[keep], k.ravel()[keep]
        i, j = np.minimum(i, j), np.maximum(i, j)
        if mirrored:
            i, j, k = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([k, k])
        return pd.DataFrame({"i": i, "j": j, "k": k})

    return pairs(a, a, key, run, "i long, j long, k double", symmetric=True, block=block, widest=BLOCK)


def full(upper: DataFrame, rows: DataFrame, key: str = "i") -> DataFrame:
    """Both halves and the diagonal."""
    return diagonal(upper.union(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "k")), rows, key)


def diagonal(halves: DataFrame, rows: DataFrame, key: str = "i") -> DataFrame:
    """Both halves with the diagonal."""
    return halves.union(rows.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(1.0)))


def kernel_sums(rows: DataFrame, kernel: Kernel, key: str = "i", vector: str = "x", label: str = "y", block: int = BLOCK) -> DataFrame:
    """One row of sums over pairs i < j (n, k, k * k, k of equal labels), taken block by block: no table of pairs is written."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        k = kernel(matrix(x[vector]), matrix(y[vector]))
        same = x[label].to_numpy()[:, None] == y[label].to_numpy()
        keep = x[key].to_numpy()[:, None] < y[key].to_numpy() if x["_block"].iloc[0] == y["_block"].iloc[0] else np.ones(k.shape, bool)
        return pd.DataFrame({"n": [int(keep.sum())], "k1": [k[keep].sum()], "k2": [(k[keep] ** 2).sum()], "same": [k[keep & same].sum()]})

    parts = pairs(rows, rows, key, run, "n long, k1 double, k2 double, same double", symmetric=True, block=block)
    return parts.agg(*[F.sum(c).alias(c) for c in ("n", "k1", "k2", "same")])


def offdiagonal_std() -> Column:
    """From kernel_sums: population deviation of the pairs, 0 without any."""
    mean = F.try_divide("k1", "n")
    return F.coalesce(F.sqrt(F.greatest(F.try_divide("k2", "n") - mean * mean, F.lit(0.0))), F.lit(0.0))


def alignment(sums: DataFrame, rows: DataFrame, label: str = "y", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of sums, with its columns `keep`: alignment with the ideal kernel (1 within a class, 0 between), that of the constant kernel, and their difference."""
    sizes = rows.groupBy(label).agg(F.count("*").cast("double").alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") ** 2).alias("ideal"))
    s = sums.crossJoin(F.broadcast(sizes))
    inner, size = 2 * F.col("same") + F.col("rows"), F.sqrt(2 * F.col("k2") + F.col("rows"))
    s = s.withColumn("alignment", F.coalesce(F.try_divide(inner, size * F.sqrt("ideal")), F.lit(0.0)))
    return s.withColumn("baseline", F.sqrt("ideal") / F.col("rows")).select(*keep, "alignment", "baseline", (F.col("alignment") - F.col("baseline")).alias("excess"))
