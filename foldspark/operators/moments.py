"""Sums over all pairs of the squared cosine, from moments of rows: the time is linear in rows and no pair is ever met.

The squared cosine of two rows is the inner product of their second-order tensors (a x a, of the unit vector a), and its square
that of their fourth-order tensors. So the sum of k over all pairs is the squared size of one sum of tensors, the sum of k * k
that of a fourth-order one, and the sum of k within a class that of the class's own. Tensors are symmetric: entries with rising
indices stand for all their orders. A scan sums them by batches with matrix products, the fourth-order one in a shard for each
second index; shards are added up over two rounds of shuffles, so a task holds a shard of some hundred tasks.

Fourth-order sums of d columns have d^4 / 24 entries: for rows of more than some hundred columns, or fewer rows than about d^3 / 12,
pairs by blocks (kernels.kernel_sums) take less time. Both are exact; sums() takes whichever is cheaper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.kernels import fidelity, kernel_sums

#: Rows whose products are held at once.
ROWS = 1024
#: Partial sums that meet in a task of the first round.
MEET = 64
#: Classes whose sums a task holds.
HELD = 1024
_PARTS = "kind string, shard long, label string, part int, rows long, ones double, x array<double>"


@lru_cache(maxsize=4)
def _pairs(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs i <= j by i, and where each i's begin."""
    i, j = np.triu_indices(d)
    return i, j, np.searchsorted(i, np.arange(d + 1))


def _orders(index: np.ndarray) -> np.ndarray:
    """In how many orders each row's indices, which don't fall, can be written."""
    n, run = np.full(len(index), factorial(index.shape[1])), np.ones(len(index), np.int64)
    for k in range(1, index.shape[1]):
        run = np.where(index[:, k] == index[:, k - 1], run + 1, 1)
        n //= run
    return n


def second_orders(d: int) -> np.ndarray:
    i, j, _ = _pairs(d)
    return _orders(np.stack([i, j], 1))


def fourth_orders(d: int, shard: int) -> np.ndarray:
    """Orders of (i, shard, k, l) for i <= shard <= k <= l, by i and then (k, l)."""
    k, l, at = _pairs(d)
    k, l = k[at[shard] :], l[at[shard] :]
    i = np.repeat(np.arange(shard + 1), len(k))
    return _orders(np.stack([i, np.full(len(i), shard), np.tile(k, shard + 1), np.tile(l, shard + 1)], 1))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _products(x: np.ndarray) -> np.ndarray:
    i, j, _ = _pairs(x.shape[1])
    return x[:, i] * x[:, j]


def _shards(x: np.ndarray, products: np.ndarray) -> list[np.ndarray]:
    at = _pairs(x.shape[1])[2]
    return [((x[:, : s + 1] * x[:, s : s + 1]).T @ products[:, at[s] :]).ravel() for s in range(x.shape[1])]


def _partial(vector: str, fourth: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, width, shards, classes = TaskContext.get().partitionId(), None, [], {}
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                width = width or len(b.column(0)[0])
                if set(pc.unique(pc.list_value_length(b.column(0))).to_pylist()) != {width}:
                    raise ValueError(f"{vector} has vectors of different lengths")
                x = unit(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
                products, ones = _products(x), (x**2).sum(1)
                if fourth:
                    new = _shards(x, products)
                    shards = [a + s for a, s in zip(shards, new, strict=True)] if shards else new
                y = b.column(1).dictionary_encode()
                which = y.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for k in np.unique(which):
                    own = which == k
                    name = None if k < 0 else y.dictionary[int(k)].as_py()
                    n, o, t = classes.get(name, (0, 0.0, 0.0))
                    classes[name] = n + int(own.sum()), o + float(ones[own].sum()), t + products[own].sum(0)
                if len(classes) > HELD:
                    yield _batch([("class", 0, name, part, *c) for name, c in classes.items()])
                    classes = {}
        yield _batch([("class", 0, name, part, *c) for name, c in classes.items()] + [("fourth", k, None, part, 0, 0.0, s) for k, s in enumerate(shards)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _added(g: pd.DataFrame) -> pd.DataFrame:
    return g.iloc[:1].assign(rows=g["rows"].sum(), ones=g["ones"].sum(), x=[np.sum(np.stack(g["x"].to_numpy()), axis=0)])


def tensors(rows: DataFrame, vector: str = "x", label: str = "y", fourth: bool = True) -> DataFrame:
    """(kind, shard, label, part, rows, ones, x): second-order sums of each class ('class'), and shards of the fourth-order one ('fourth').

    A null vector is no row; a vector of zeros counts as one, with similarity 0 to all and to itself. rows: how many; ones: the sum of
    each row's similarity to itself. Null labels are a class of their own here.
    """
    t = rows.select(F.col(vector).alias("x"), F.col(label).cast("string").alias("y")).mapInArrow(_partial(vector, fourth), _PARTS)
    t = t.withColumn("part", F.floor(F.col("part") / MEET).cast("int")).groupBy("kind", "shard", "label", "part").applyInPandas(_added, _PARTS)
    return t.withColumn("part", F.lit(0)).groupBy("kind", "shard", "label").applyInPandas(_added, _PARTS)


def _squares(t: DataFrame) -> DataFrame:
    """(kind, label, rows, ones, size): the squared size of each tensor or shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = []
            for kind, shard, x in zip(b["kind"], b["shard"], b["x"], strict=True):
                d = _columns(len(x)) if kind != "fourth" else None
                orders = second_orders(d) if d else fourth_orders(_columns_of_shard(len(x), int(shard)), int(shard))
                sizes.append(float((orders * np.asarray(x) ** 2).sum()))
            yield pd.DataFrame({"kind": b["kind"], "label": b["label"], "rows": b["rows"], "ones": b["ones"], "size": sizes})

    return t.mapInPandas(run, "kind string, label string, rows long, ones double, size double")


def _columns(entries: int) -> int:
    return int((np.sqrt(8 * entries + 1) - 1) // 2)


def _columns_of_shard(entries: int, shard: int) -> int:
    return shard + _columns(entries // (shard + 1))


def _all(g: pd.DataFrame) -> pd.DataFrame:
    return _added(g).assign(kind="all", label=None)


def moment_sums(rows: DataFrame, vector: str = "x", label: str = "y") -> DataFrame:
    """One row of sums over pairs i < j of the squared cosine (n, k1, k2, same), as kernels.kernel_sums has them."""
    t = tensors(rows, vector, label)
    classes = t.filter("kind = 'class'")
    # classes are added up by shares of their own, then once: a row for each task of the first round
    whole = classes.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(MEET)).cast("int")).groupBy("part").applyInPandas(_all, _PARTS)
    whole = whole.groupBy("kind").applyInPandas(_all, _PARTS)
    s = _squares(t.union(whole))
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    named = (F.col("kind") == "class") & F.col("label").isNotNull()
    s = s.agg(
        of("class", "rows").alias("rows"), of("all", "size").alias("k1"), of("fourth", "size").alias("k2"), of("class", "ones").alias("ones"),
        F.coalesce(F.sum(F.when(named, F.col("size") - F.col("ones"))), F.lit(0.0)).alias("same"),
    )
    n = (F.col("rows") * (F.col("rows") - 1) / 2).cast("long")
    # a row's similarity to itself is 1, or 0 for zeros: so is its square
    return s.select(n.alias("n"), ((F.col("k1") - F.col("ones")) / 2).alias("k1"), ((F.col("k2") - F.col("ones")) / 2).alias("k2"), (F.col("same") / 2).alias("same"))


def mean_similarity(rows: DataFrame, key: str = "i", vector: str = "x", label: str = "y", name: str = "k_mean") -> DataFrame:
    """(key, name): mean squared cosine of each row with all rows, itself included: its own tensor's product with the mean tensor of all."""
    classes = tensors(rows, vector, label, fourth=False)
    whole = classes.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(MEET)).cast("int")).groupBy("part").applyInPandas(_all, _PARTS)
    total = whole.groupBy("kind").applyInPandas(_all, _PARTS).first()  # columns times columns
    if total is None or not total["rows"]:
        return rows.select(key, F.lit(0.0).alias(name)).limit(0)
    x = np.array(total["x"])
    mean = second_orders(_columns(len(x))) * x / total["rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                u = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
                yield pa.record_batch({key: b.column(0), name: pa.array(_products(u) @ mean)})

    kind = dict(rows.dtypes)[key]
    each = rows.select(key, F.col(vector).alias("x")).mapInArrow(run, f"{key} {kind}, {name} double")
    return each.groupBy(key).agg(F.avg(name).alias(name))


def sums(rows: DataFrame, columns: int, key: str = "i", vector: str = "x", label: str = "y") -> DataFrame:
    """kernel_sums of the squared cosine by whichever way takes fewer products."""
    n = rows.count()
    if n * columns / 2 < columns**4 / 24:
        return kernel_sums(rows, partial(fidelity, encoding="amplitude"), key, vector, label)
    return moment_sums(rows, vector, label)
