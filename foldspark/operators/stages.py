"""Pipeline stages: estimators and models that fit on a fold's training rows, can be saved, and are searched over by folds.

FeatureChain fits a variance filter, the greedy correlation filter, standardisation (population deviation) and, on request, principal
components, all from one scan: tasks add up products of columns, shards of rows of that matrix are added up in a shuffle, and what
reaches the driver is columns times columns, however many rows there are. A fitted chain is a model with plain parameters, so Spark's
own writers save it. MacroF1 is an evaluator for CrossValidator, and `nested` is cross-validation in cross-validation by fold columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators import metrics
from foldspark.operators.features import greedy_kept
from foldspark.operators.sampling import folds, gathered

#: Rows of the products' matrix in a shard.
SHARD = 128


def as_array(df: DataFrame, column: str) -> Column:
    """A vector or array column as an array of doubles."""
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.transform(column, lambda x: x.cast("double"))


def rows_of(column: pa.Array) -> np.ndarray:
    """A matrix from a column of arrays, which all have one length and no nulls."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def products(df: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, a base, sums of columns less the base, sums of their products) over rows without a null vector.

    The base is a row's vector: differences from it keep sums small where means are large.
    """
    x = df.select(as_array(df, column).alias("x")).filter("x IS NOT NULL")
    first = x.first()
    if first is None:
        raise ValueError(f"no rows with {column} to fit on")
    base = np.array(first["x"], float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = np.column_stack([np.ones(b.num_rows), rows_of(b.column(0)) - base])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.record_batch({"shard": np.arange(0, len(total), SHARD) // SHARD, "p": pa.array([total[k : k + SHARD].tobytes() for k in range(0, len(total), SHARD)], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        return pa.table({"shard": t.column("shard")[:1], "p": pa.array([sum(np.frombuffer(p.as_py()) for p in t.column("p")).tobytes()], pa.binary())})

    ddl = "shard long, p binary"
    got = x.mapInArrow(add, ddl).groupBy("shard").applyInArrow(total, ddl).sort("shard").collect()
    p = np.concatenate([np.frombuffer(r["p"]) for r in got]).reshape(len(base) + 1, -1)
    return int(p[0, 0]), base, p[0, 1:], p[1:, 1:]


class _Chain(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    variance = Param(Params._dummy(), "variance", "columns of no more variance go", TypeConverters.toFloat)
    correlation = Param(Params._dummy(), "correlation", "the later column of a pair with a larger correlation goes", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "principal components; 0: the standardised columns themselves", TypeConverters.toInt)


class FeatureChain(Estimator, _Chain):
    """Fits a FeatureChainModel. Null vectors are left out of the fit; components beyond the columns that stay are an error."""

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "scaled", variance: float = 0.0, correlation: float = 0.95, components: int = 0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", variance=0.0, correlation=0.95, components=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureChainModel:
        n, base, s, p = products(dataset, self.getInputCol())
        mean, cov = base + s / n, p / n - np.outer(s / n, s / n)
        var = np.maximum(cov.diagonal(), 0)
        varies = var > np.maximum(self.getOrDefault(self.variance), 1e-12 * (mean**2 + 1))
        scale = np.sqrt(np.where(varies, var, 1))
        r = cov / np.outer(scale, scale)
        kept = np.flatnonzero(varies)
        kept = kept[greedy_kept(r[np.ix_(kept, kept)], self.getOrDefault(self.correlation))]
        components = self.getOrDefault(self.components)
        if components > len(kept):
            raise ValueError(f"{components} components of {len(kept)} features")
        axes, explained = np.zeros((0, len(kept))), []
        if components:
            values, vectors = np.linalg.eigh(r[np.ix_(kept, kept)])
            order = np.argsort(-values)[:components]
            axes = (vectors[:, order] * np.sign(vectors[np.argmax(np.abs(vectors[:, order]), 0), order])).T
            explained = (values[order] / len(kept)).tolist()
        model = FeatureChainModel(width=len(base), kept=kept.tolist(), mean=mean[kept].tolist(), scale=scale[kept].tolist(), axes=axes.ravel().tolist(), explained=explained)
        return self._copyValues(model)


class FeatureChainModel(Model, _Chain):
    """Vectors of the columns that stay, standardised, or of their principal components. A null vector stays null."""

    width = Param(Params._dummy(), "width", "columns of the input", TypeConverters.toInt)
    kept = Param(Params._dummy(), "kept", "columns that stay", TypeConverters.toListInt)
    mean = Param(Params._dummy(), "mean", "their means", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "their population deviations", TypeConverters.toListFloat)
    axes = Param(Params._dummy(), "axes", "components, row by row", TypeConverters.toListFloat)
    explained = Param(Params._dummy(), "explained", "share of variance of each component", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, width: int = 0, kept: list[int] = (), mean: list[float] = (), scale: list[float] = (), axes: list[float] = (), explained: list[float] = ()):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", variance=0.0, correlation=0.95, components=0)
        self._set(**self._input_kwargs)

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, their means, and what their differences are multiplied by."""
        kept, mean, scale = (np.array(self.getOrDefault(p)) for p in (self.kept, self.mean, self.scale))
        axes = np.array(self.getOrDefault(self.axes)).reshape(-1, len(kept)) if len(self.getOrDefault(self.axes)) else np.eye(len(kept))
        return kept.astype(int), mean, (axes / scale).T

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept, mean, by = self.matrix()
        width = self.getOrDefault(self.width)

        def apply(x: np.ndarray) -> np.ndarray:
            if x.shape[1] != width:
                raise ValueError(f"vectors of {x.shape[1]} columns, not {width}")
            return (x[:, kept] - mean) @ by

        return dataset.withColumn(self.getOutputCol(), mapped(apply)(as_array(dataset, self.getInputCol())))


def mapped(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of matrices of rows, for columns of arrays; gives a vector column, null where the array is null."""

    @F.pandas_udf("array<double>")
    def each(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        some = x.notna().to_numpy()
        if some.any():
            out[some] = pd.Series(list(f(np.stack(x[some].to_numpy()).astype(float))), index=out.index[some])
        return out

    return lambda c: F.when(c.isNotNull(), array_to_vector(each(c)))


class MacroF1(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The mean of all classes' F1, of labels and predictions alike; 0 without rows."""

    @keyword_only
    def __init__(self, *, labelCol: str = "y", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(labelCol="y", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(F.col(self.getLabelCol()).cast("int").alias("y"), F.col(self.getPredictionCol()).cast("int").alias("p"))
        row = metrics.summary(metrics.confusion(pairs)).first()
        return float(row["f1_macro"]) if row is not None and row["f1_macro"] is not None else 0.0


def nested(rows: DataFrame, estimator: Estimator, grid: list[dict], k: int = 3, inner: int = 3, seed: int = 42, parallelism: int = 4, path: str | None = None) -> DataFrame:
    """rows (row_id, y, features) with fold, prediction and the estimator's further columns: each fold predicted by the best of
    `grid`, by macro F1 over `inner` folds of the other rows, fitted again on all of them.

    Folds are columns, so an inner fold never sees the held-out rows. path: where each fold's fitted pipeline is saved.
    """
    n = rows.count()
    data = gathered(folds(rows, "y", "row_id", k, seed), "row_id", n).persist()

    def one(fold: int) -> DataFrame:
        if len(grid) > 1:
            train = gathered(_inner(data, fold, inner, seed), "row_id", n).persist()  # else each scan of a fit ranks all rows again
            search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=MacroF1(), numFolds=inner, foldCol="inner", parallelism=parallelism)
            model = search.fit(train).bestModel
            train.unpersist()
        else:
            model = estimator.fit(data.filter(F.col("fold") != fold), grid[0] if grid else {})
        if path:
            model.write().overwrite().save(f"{path}/fold={fold}")
        return model.transform(data.filter(F.col("fold") == fold))

    with ThreadPoolExecutor(k) as pool:  # folds don't depend on each other; each is a job of its own on the cluster
        return reduce(DataFrame.unionByName, pool.map(one, range(k)))


def _inner(data: DataFrame, fold: int, inner: int, seed: int) -> DataFrame:
    outer = data.filter(F.col("fold") != fold).withColumnRenamed("fold", "outer")
    return folds(outer, "y", "row_id", inner, seed + 1).withColumnRenamed("fold", "inner").withColumnRenamed("outer", "fold")
