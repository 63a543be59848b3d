"""Landmark feature maps: rows become vectors whose inner products are a kernel's values, near enough, so that linear models on all
rows stand for kernel machines.

Of m landmarks Z, a row x becomes L^-1 k(Z, x), where L L' = k(Z, Z): the Nystroem map, exact on the landmarks and on whatever lies in
their span. Landmarks are drawn as k-means++ draws centres, some at a time: a row's chance is its squared distance, in the kernel's own
space, from the nearest landmark so far. A draw is the top n of -log(u) / distance over all rows, with u from a hash of the vector: no
row leaves its task but the n least of each, and reruns agree. The map needs m * m numbers, whatever the number of rows; rows are mapped
in batches.

Cases: rows with a null vector are never landmarks and stay null; equal rows are drawn once, so a table of fewer different rows than m
has all of them as landmarks; no rows at all are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import kernels
from foldspark.operators.stages import as_array, mapped, products

KERNELS = ("rbf", "amplitude")
#: Added to the landmarks' own kernel, whose least values may be lost in rounding.
RIDGE = 1e-9


def kernel(name: str, gamma: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return kernels.rbf(a, b, gamma) if name == "rbf" else kernels.fidelity(a, b, "amplitude")


class _Landmarks(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    name = Param(Params._dummy(), "name", "rbf or amplitude", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "width of the rbf kernel; 0: 1 / (columns * variance of all values)", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "how many", TypeConverters.toInt)
    draws = Param(Params._dummy(), "draws", "in how many draws", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the draws", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(inputCol="features", outputCol="mapped", name="rbf", gamma=0.0, landmarks=128, draws=4, seed=42)


class LandmarkMap(Estimator, _Landmarks):
    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "mapped", name: str = "rbf", gamma: float = 0.0, landmarks: int = 128, draws: int = 4, seed: int = 42):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LandmarkMapModel:
        o = self.getOrDefault
        name, gamma, m = o(self.name), o(self.gamma), o(self.landmarks)
        if name not in KERNELS:
            raise ValueError(f"unknown kernel: {name}")
        if name == "rbf" and not gamma:
            n, base, s, p = products(dataset, self.getInputCol())
            mean, square = (base + s / n).mean(), (p.diagonal() / n + 2 * base * s / n + base**2).mean()
            gamma = 1 / (len(base) * (square - mean**2)) if square > mean**2 else 1.0
        rows = dataset.select(as_array(dataset, self.getInputCol()).alias("x")).filter("x IS NOT NULL").persist()
        found: list[list[float]] = []
        for draw in range(o(self.draws) + 1):
            want = 1 if draw == 0 else -(-(m - len(found)) // (o(self.draws) - draw + 1))
            new = _draw(rows, np.array(found), name, gamma, min(want, m - len(found)), o(self.seed) + draw)
            found += new
            if not new or len(found) == m:
                break
        rows.unpersist()
        if not found:
            raise ValueError(f"no rows with {self.getInputCol()} to fit on")
        model = LandmarkMapModel(width=len(found[0]), points=np.array(found).ravel().tolist())
        return self._copyValues(model)._set(gamma=float(gamma))


def _draw(rows: DataFrame, found: np.ndarray, name: str, gamma: float, n: int, seed: int) -> list[list[float]]:
    """n different rows, none of those found; the farther from them, the likelier."""

    def own(x: np.ndarray) -> np.ndarray:
        """Each row's kernel with itself."""
        return np.ones(len(x)) if name == "rbf" else (np.abs(x).sum(1) > 0).astype(float)

    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        x = np.stack(x.to_numpy()).astype(float)
        if not len(found):
            return pd.Series(np.ones(len(x)))
        return pd.Series(np.maximum(own(x)[:, None] + own(found) - 2 * kernel(name, gamma, x, found), 0.0).min(1))

    u = (F.xxhash64("x", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    far = F.col("d") > (1e-9 if len(found) else -1.0)
    first = rows.withColumn("d", distance("x")).filter(far).select("x", (-F.log(u) / F.greatest("d", F.lit(1e-12))).alias("key"))
    # equal rows have equal keys and stand side by side: as many as there are copies of the n least are looked at
    taken: list[list[float]] = []
    while len(taken) < n:
        after = F.lit(True) if not taken else F.col("key") > last
        got = first.filter(after).groupBy("key").agg(F.first("x").alias("x")).orderBy("key").limit(n - len(taken)).collect()
        if not got:
            break
        taken += [list(r["x"]) for r in got]
        last = got[-1]["key"]
    return taken


class LandmarkMapModel(Model, _Landmarks):
    width = Param(Params._dummy(), "width", "columns of a row", TypeConverters.toInt)
    points = Param(Params._dummy(), "points", "landmarks, row by row", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, width: int = 0, points: list[float] = ()):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        o = self.getOrDefault
        name, gamma, z = o(self.name), o(self.gamma), np.array(o(self.points)).reshape(-1, o(self.width))
        own = kernel(name, gamma, z, z)
        root = np.linalg.inv(np.linalg.cholesky(own + RIDGE * np.eye(len(z)))).T

        def apply(x: np.ndarray) -> np.ndarray:
            if x.shape[1] != z.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} columns, not {z.shape[1]}")
            return kernel(name, gamma, x, z) @ root

        return dataset.withColumn(self.getOutputCol(), mapped(apply)(as_array(dataset, self.getInputCol())))
