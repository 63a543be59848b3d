"""Hinge-loss machines fitted side by side over the cluster: a pass over the rows gives losses and gradients of all machines at once.

Tasks add up losses and gradients by matrix products, one small shuffle adds up the tasks, and the driver takes a step of L-BFGS for each
machine: it holds machines times columns, however many rows there are. A machine whose step was too long tries half of it in the next
pass; one that has converged rests. One-vs-rest machines of all classes, of several settings and of several folds so share each pass.

A fidelity kernel of q qubits is an inner product of density matrices: 4^q columns (`densities`). A kernel machine on it is a linear
machine on those columns, exactly, so rows need no Gram table and any number of them can be fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators import kernels
from foldspark.operators.stages import as_array, mapped, products, rows_of

#: Rows whose margins are held at once; steps that L-BFGS remembers; halvings of a step, at most.
ROWS, MEMORY, HALVINGS = 4096, 8, 20


def densities(x: np.ndarray, encoding: str, bandwidth: float = 1.0) -> np.ndarray:
    """Columns whose inner products are the fidelity kernel: a state's density matrix as real numbers."""
    s = kernels.states(x, encoding, bandwidth)
    i, j = np.triu_indices(s.shape[1], 1)
    off = np.sqrt(2) * s[:, i] * s[:, j].conj()
    return np.hstack([np.abs(s) ** 2, off.real, off.imag] if np.iscomplexobj(s) else [s**2, off])


def hinge(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A row for each machine: the sum of its losses, then its gradient. x: rows by columns, the last of ones; sign, weight: rows by machines."""
    gap = 1 - sign * (x @ w.T)
    push = np.where(gap > 0, weight, 0.0)
    return np.column_stack([(push * gap).sum(0), -(push * sign).T @ x])


class _Machine:
    """A machine's place in its own search."""

    def __init__(self, d: int):
        self.w, self.f, self.g, self.done, self.steps = np.zeros(d), np.inf, np.zeros(d), False, 0
        self.trial, self.pairs, self.step, self.halved = np.zeros(d), [], 1.0, 0

    def direction(self) -> np.ndarray:
        q, a = self.g.copy(), []
        for s, y, r in reversed(self.pairs):
            a.append(r * (s @ q))
            q -= a[-1] * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), b in zip(self.pairs, reversed(a), strict=True):
            q += s * (b - r * (y @ q))
        return -q

    def saw(self, f: float, g: np.ndarray, most: int, tolerance: float) -> None:
        if self.f < np.inf and not f <= self.f + 1e-4 * self.step * self.slope:
            self.step, self.halved = self.step / 2, self.halved + 1
            if self.halved > HALVINGS:
                if not self.pairs:
                    self.done = True
                    return
                self.pairs = []
                self.aim()
            self.trial = self.w + self.step * self.p
            return
        if self.f < np.inf:
            s, y = self.trial - self.w, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y, 1 / (s @ y))]
            self.steps += 1
            self.done = self.steps >= most or self.f - f <= tolerance * abs(self.f)
        self.w, self.f, self.g = self.trial, f, g
        self.done |= not np.abs(g).max() > 1e-12
        self.aim()

    def aim(self) -> None:
        self.p = self.direction()
        self.slope, self.halved = float(self.g @ self.p), 0
        if not self.slope < 0:
            self.pairs, self.p = [], -self.g
            self.slope = -float(self.g @ self.g)
        self.step = 1.0 if self.pairs else min(1.0, 1 / max(np.linalg.norm(self.g), 1e-12))
        self.trial = self.w + self.step * self.p


def minimise(evaluate: Callable[[np.ndarray], np.ndarray], penalty: np.ndarray, steps: int, passes: int, tolerance: float = 1e-5) -> np.ndarray:
    """Weights of each machine (a row). evaluate: of all machines' weights, as `hinge` gives them, divided by rows. penalty: by machine and
    column, half of which times the squared weight is added. At most `steps` steps of a machine and `passes` passes in all."""
    ms = [_Machine(penalty.shape[1]) for _ in penalty]
    for _ in range(passes):
        at = np.stack([m.w if m.done else m.trial for m in ms])
        got = evaluate(at)
        for m, r, w, c in zip(ms, got, at, penalty, strict=True):
            if not m.done:
                m.saw(float(r[0] + (c * w * w).sum() / 2), r[1:] + c * w, steps, tolerance)
        if all(m.done for m in ms):
            break
    return np.stack([m.w for m in ms])


def added(df: DataFrame, part: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all batches of matrices by key; a key's matrix is added up in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                for k, m in part(b.slice(lo, ROWS)).items():
                    sums[k] = sums[k] + m if k in sums else m
        if sums:
            yield pa.record_batch({"k": pa.array(list(sums), pa.int64()), "m": pa.array([np.ascontiguousarray(m).tobytes() for m in sums.values()], pa.binary()), "c": pa.array([m.shape[1] for m in sums.values()], pa.int64())})

    def total(t: pa.Table) -> pa.Table:
        return pa.table({"k": t.column("k")[:1], "m": pa.array([sum(np.frombuffer(m.as_py()) for m in t.column("m")).tobytes()], pa.binary()), "c": t.column("c")[:1]})

    ddl = "k long, m binary, c long"
    return {r["k"]: np.frombuffer(r["m"]).reshape(-1, r["c"]) for r in df.mapInArrow(run, ddl).groupBy("k").applyInArrow(total, ddl).collect()}


class _OneVsRest(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    maxIter = Param(Params._dummy(), "maxIter", "steps of a machine, at most", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "half of it times the squared weights of standardised columns is added to the mean loss", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction", maxIter=100, regParam=0.0)


class HingeMachines(Estimator, _OneVsRest):
    """One linear machine for each class against the rest, all of them in each pass. Null vectors and labels are left out of the fit."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", rawPredictionCol: str = "rawPrediction", maxIter: int = 100, regParam: float = 0.0):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> HingeMachinesModel:
        rows = dataset.select(as_array(dataset, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, base, s, p = products(rows, "x")
            mean = s / n
            scale = np.sqrt(np.maximum(p.diagonal() / n - mean**2, 0))
            keep = scale > 1e-12 * (np.abs(base + mean) + 1)  # a constant column gets no weight
            mean, by = base + mean, np.where(keep, 1 / np.where(keep, scale, 1), 0)
            classes = rows.agg(F.max("y")).first()[0] + 1

            def evaluate(w: np.ndarray) -> np.ndarray:
                def part(b: pa.RecordBatch) -> dict[int, np.ndarray]:
                    x = np.column_stack([(rows_of(b.column(0)) - mean) * by, np.ones(b.num_rows)])
                    sign = np.where(b.column(1).to_numpy(zero_copy_only=False)[:, None] == np.arange(classes), 1.0, -1.0)
                    return {0: hinge(x, sign, np.ones(sign.shape), w)}

                return added(rows, part)[0] / n

            steps = self.getOrDefault(self.maxIter)
            penalty = np.tile(np.append(np.full(len(by), self.getOrDefault(self.regParam)), 0.0), (classes, 1))
            w = minimise(evaluate, penalty, steps, 4 * steps)
        finally:
            rows.unpersist()
        weights = w[:, :-1] * by
        model = HingeMachinesModel(weights=weights.ravel().tolist(), offsets=(w[:, -1] - weights @ mean).tolist())
        return self._copyValues(model)


class HingeMachinesModel(Model, _OneVsRest):
    """Margins of all classes, and the class of the largest; null where the vector is null."""

    weights = Param(Params._dummy(), "weights", "of each class, one after the other", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "of each class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, weights: list[float] = (), offsets: list[float] = ()):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        offsets = np.array(self.getOrDefault(self.offsets))
        weights = np.array(self.getOrDefault(self.weights)).reshape(len(offsets), -1)
        out = dataset.withColumn(self.getRawPredictionCol(), mapped(lambda x: x @ weights.T + offsets)(as_array(dataset, self.getFeaturesCol())))
        return out.withColumn(self.getPredictionCol(), largest(self.getRawPredictionCol()))


def largest(raw: str) -> Column:
    """The place of a vector's largest value, the first of equal ones."""
    values = vector_to_array(raw)
    return F.when(F.col(raw).isNotNull(), (F.array_position(values, F.array_max(values)) - 1).cast("double"))
