"""Boosting of all classes at once: each round adds a tree for each class, fitted to the softmax loss's first and second derivatives.

Trees grow level by level. In a level every task adds up derivatives by (class, node, column, bin) over its rows and sends them in blocks
of columns; one shuffle adds them up and finds each node's best split, and a row for each node comes back. So no task holds the rows,
and what is sent doesn't grow with them. Once no node has more than NODE rows, each node's rows go to a task that grows the rest of its
tree by the same splits: one job for all lower levels, and over few rows one for a whole round. A table of at most ALONE rows is one
partition, whose task grows all rounds. Columns are cut into bins by quantiles of a sample of SAMPLE values (a row is in the sample by
the hash of its vector), kept with the binned rows; binning and scores are written to the shared folder every ROUNDS rounds, and the
rounds since then are applied as rows are read, so a lost executor costs a rescan and no chain of rounds.

Cases: rows with a null vector or label are left out of the fit, and a null vector's prediction is null; NaN is in the last bin; equal
gains go to the first column and bin; sums are taken in the order of tasks, so reruns over the same files give the same trees.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.stages import as_array, rows_of
from foldspark.sources.shared import shared_dir

#: Values of a sample that bins are taken from, at most; columns that are added up in one group; cells of a task's sums; rounds between writes.
SAMPLE, COLUMNS, CELLS, ROUNDS = 4_000_000, 64, 1 << 24, 10
#: Rows of a node whose lower levels are grown in one task, at most; values that it adds up at once; bytes of shuffles after which old ones are let go.
NODE, VALUES, SENT = 1 << 17, 1 << 16, 1 << 28
#: Rows in a file of binned rows, so that a pass over few rows has few tasks; rows of a table that is one partition.
FILE, ALONE = 8192, 2048


class Tree(NamedTuple):
    """A full binary tree: column and bin of each inner node (column -1: all rows go left), value of each leaf."""

    column: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    def node(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at a depth, counted from the left."""
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            inner = at + (1 << level) - 1
            c = self.column[inner]
            right = (c >= 0) & (x[np.arange(len(x)), np.maximum(c, 0)] > self.bin[inner])
            at = 2 * at + right
        return at


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])  # values up to an edge are left of it; NaN comes last
    return out


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scores(x: np.ndarray, start: np.ndarray, rounds: list[list[Tree]], depth: int) -> np.ndarray:
    f = start.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            f[:, k] += t.leaf[t.node(x, depth)]
    return f


def derivatives(f: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = softmax(f)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return g * w[:, None], p * (1 - p) * w[:, None]


def histogram(x: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """(node, column, bin, 2): sums of both derivatives."""
    columns, at = np.ascontiguousarray(x.T), node * bins
    out = np.empty((nodes, len(columns), bins, 2))
    for c, column in enumerate(columns):  # a column's cells stay in the cache
        cell = at + column
        for i, v in enumerate((g, h)):
            out[:, c, :, i] = np.bincount(cell, v, nodes * bins).reshape(nodes, bins)
    return out


def best_split(s: np.ndarray, l2: float, least: float) -> tuple[float, int, int, float, float, float, float]:
    """(gain, column, bin, left g, left h, g, h) of sums by (column, bin); column -1 if none is left of enough weight and a gain."""
    left = np.cumsum(s, axis=1)
    total = left[:, -1:, :]
    right = total - left
    gain = left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[..., 0] ** 2 / (total[..., 1] + l2)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf)
    c, b = np.unravel_index(np.argmax(gain), gain.shape)
    g, h = total[0, 0]
    if not gain[c, b] > 1e-9:
        return 0.0, -1, 0, g, h, g, h
    return float(gain[c, b]), int(c), int(b), *left[c, b], g, h


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, rate: float, l2: float, least: float) -> Tree:
    """The tree of so many levels below a node, with the splits that best_split finds."""
    n, d = x.shape
    tree = Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth))
    at, live = np.zeros(n, np.int64), np.arange(n)  # each row's node; rows in nodes that may be split
    for level in range(depth):
        if len(live):
            names, inner, sizes = np.unique(at[live], return_inverse=True, return_counts=True)
            some = (sizes > 1)[inner]  # a row alone isn't split
            live, inner = live[some], inner[some]
        cuts = np.full(1 << level, -1), np.zeros(1 << level, np.int64)
        if len(live):
            keep = np.flatnonzero(sizes > 1)
            names, own = names[keep], np.searchsorted(keep, inner)
            for lo in range(0, len(names), step := max(1, CELLS // (d * bins * 8))):
                part = slice(None) if len(names) <= step else (own >= lo) & (own < lo + step)
                rows, to = live[part], own[part] - lo
                c, b = splits(x[rows], to, g[rows], h[rows], min(step, len(names) - lo), bins, l2, least)
                cuts[0][names[lo : lo + step]], cuts[1][names[lo : lo + step]] = c, b
            live = live[cuts[0][at[live]] >= 0]
        tree.column[(1 << level) - 1 : (2 << level) - 1], tree.bin[(1 << level) - 1 : (2 << level) - 1] = cuts
        node, at = at[live], 2 * at
        at[live] += x[live, cuts[0][node]] > cuts[1][node]
    sums = [np.bincount(at, v, 1 << depth) for v in (g, h)]
    np.divide(-rate * sums[0], sums[1] + l2, out=tree.leaf, where=sums[1] > 0)
    return tree


def splits(x: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int, l2: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(column, bin) of each node's best split; column -1 where none is left."""
    n, d = x.shape
    left = np.empty((2, nodes, d, bins))
    for lo in range(0, d, step := max(1, VALUES // n)):
        own = x[:, lo : lo + step]
        w = own.shape[1]
        cell = ((node[:, None] * w + np.arange(w)) * bins + own).ravel()
        for v, out in zip((g, h), left, strict=True):
            out[:, lo : lo + w] = np.bincount(cell, np.repeat(v, w) if w > 1 else v, nodes * w * bins).reshape(nodes, w, bins)
    gl, hl = np.cumsum(left, axis=3, out=left)
    gr, hr = gl[..., -1:] - gl, hl[..., -1:] - hl
    none = (hl < least) | (hr < least)
    gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - gl[..., -1:] ** 2 / (hl[..., -1:] + l2)
    gain[none] = -np.inf
    gain = gain.reshape(nodes, -1)
    best = gain.argmax(1)
    return np.where(gain[np.arange(nodes), best] > 1e-9, best // bins, -1), best % bins


class _Boosting(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    trees = Param(Params._dummy(), "trees", "rounds, of a tree for each class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a step that is taken", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "weight of squared leaf values", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "second derivatives of a node, at least", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a column, 256 at most", TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "column of weights; empty: all 1", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(trees=20, depth=3, rate=0.3, l2=1.0, least=1e-3, bins=32, weightCol="", featuresCol="features", labelCol="y", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction")


class SoftmaxBoosting(Estimator, _Boosting):
    @keyword_only
    def __init__(self, *, trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 1e-3, bins: int = 32, weightCol: str = "", featuresCol: str = "features", labelCol: str = "y"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        spark, o = dataset.sparkSession, self.getOrDefault
        weight = F.col(o(self.weightCol)).cast("double") if o(self.weightCol) else F.lit(1.0)
        rows = dataset.select(as_array(dataset, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"), weight.alias("w")).filter("x IS NOT NULL AND y IS NOT NULL")
        top = rows.agg(F.max("y").alias("k"), F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
        if top["k"] is None:
            raise ValueError("no rows to fit on")
        classes, width, depth, bins = top["k"] + 1, top["d"], o(self.depth), o(self.bins)
        sample = np.array([r["x"] for r in rows.orderBy(F.xxhash64("x")).limit(max(1, SAMPLE // width)).select("x").collect()], float)
        edges = [np.unique(np.nanquantile(c, np.arange(1, bins) / bins, method="inverted_cdf")) if not np.isnan(c).all() else np.zeros(0) for c in sample.T]
        base = f"{shared_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"

        def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = binned(rows_of(b.column(0)), edges)
                yield pa.record_batch({"x": pa.array([r.tobytes() for r in x], pa.binary()), "y": b.column(1), "w": b.column(2), "f": pa.array([b"\0" * (8 * classes)] * len(x), pa.binary())})

        held = rows.mapInArrow(state, "x binary, y int, w double, f binary").coalesce(-(-top["n"] // FILE))
        held.write.parquet(f"{base}/0")
        held, rounds, since, sent = spark.read.parquet(f"{base}/0"), [], [], 0
        if top["n"] <= ALONE:
            rounds = self._alone(held, classes, width, [len(e) + 1 for e in edges])
        for r in range(len(rounds), o(self.trees)):
            if len(since) == ROUNDS:
                _advanced(held, since, depth, width, classes).write.parquet(f"{base}/{r}")
                held, since = spark.read.parquet(f"{base}/{r}"), []
            trees = self._round(held, since, classes, width, [len(e) + 1 for e in edges], top["n"])
            sent += top["n"] * classes * (width + 16)
            if sent > SENT:
                spark._jvm.System.gc()  # shuffle files of rounds before go when the driver's JVM collects what stood for them
                sent = 0
            rounds.append(trees)
            since.append(trees)
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        flat = lambda name: np.concatenate([getattr(t, name) for trees in rounds for t in trees]) if rounds else np.zeros(0)
        model = SoftmaxBoostingModel(
            classes=classes, edges=np.concatenate(edges).tolist(), sizes=[len(e) for e in edges],
            columns=flat("column").astype(int).tolist(), cuts=flat("bin").astype(int).tolist(), leaves=flat("leaf").tolist())
        return self._copyValues(model)

    def _alone(self, held: DataFrame, classes: int, width: int, sizes: list[int]) -> list[list[Tree]]:
        """All rounds over a table of few rows."""
        o = self.getOrDefault
        trees, depth, rate, l2, least = (o(p) for p in (self.trees, self.depth, self.rate, self.l2, self.least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, w, f = (np.concatenate(c) for c in zip(*[_rows(b, width, classes) for b in batches], strict=True))
            for r in range(trees):
                g, h = derivatives(f, y, w)
                new = [grown(x, g[:, k], h[:, k], depth, max(sizes), rate, l2, least) for k in range(classes)]
                f = scores(x, f, [new], depth)
                yield pa.record_batch({"round": pa.array([r] * classes, pa.int32()), "k": pa.array(range(classes), pa.int32())} | {c: pa.array([getattr(t, c).tobytes() for t in new], pa.binary()) for c in Tree._fields})

        got = held.coalesce(1).mapInArrow(run, "round int, k int, column binary, bin binary, leaf binary").sort("round", "k").collect()
        flat = [Tree(np.frombuffer(r["column"], np.int64), np.frombuffer(r["bin"], np.int64), np.frombuffer(r["leaf"])) for r in got]
        return [flat[i : i + classes] for i in range(0, len(flat), classes)]

    def _round(self, held: DataFrame, since: list[list[Tree]], classes: int, width: int, sizes: list[int], most: int) -> list[Tree]:
        o = self.getOrDefault
        depth, bins, rate, l2 = o(self.depth), max(sizes), o(self.rate), o(self.l2)
        trees = [Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth)) for _ in range(classes)]
        for level in range(depth):
            if most <= NODE:  # so have all nodes of the level
                for r in _lower(held, since, trees, level, depth, width, bins, classes, rate, l2, o(self.least)).collect():
                    t, node, n = trees[r["k"]], r["node"], 1 << (depth - level)
                    column, cut = np.frombuffer(r["column"], np.int64), np.frombuffer(r["bin"], np.int64)
                    for below in range(depth - level):
                        lo, w = (1 << (level + below)) - 1 + (node << below), 1 << below
                        t.column[lo : lo + w], t.bin[lo : lo + w] = column[w - 1 : 2 * w - 1], cut[w - 1 : 2 * w - 1]
                    t.leaf[node * n : (node + 1) * n] = np.frombuffer(r["leaf"])
                break
            # sums of all classes at once, unless they are too many cells for a task
            step = max(1, CELLS // ((1 << level) * width * bins * 2))
            found = [r for lo in range(0, classes, step) for r in _level(held, since, trees, level, depth, width, bins, classes, range(lo, min(lo + step, classes)), l2, o(self.least)).collect()]
            most = max((r["rows"] for r in found), default=0)
            for r in found:
                t, node = trees[r["k"]], r["node"]
                inner = node + (1 << level) - 1
                t.column[inner], t.bin[inner] = r["column"], r["bin"]
                below = 1 << (depth - level - 1)  # leaves under each child
                value = lambda g, h: -rate * g / (h + l2)
                t.leaf[2 * node * below] = value(r["gl"], r["hl"])
                if r["column"] >= 0:
                    t.leaf[(2 * node + 1) * below] = value(r["g"] - r["gl"], r["h"] - r["hl"])
        return trees


def _rows(b: pa.RecordBatch, width: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, width)
    f = np.frombuffer(b"".join(b.column("f").to_pylist())).reshape(-1, classes)
    return x, b.column("y").to_numpy(), b.column("w").to_numpy(), f


def _advanced(held: DataFrame, since: list[list[Tree]], depth: int, width: int, classes: int) -> DataFrame:
    """held with scores after the rounds since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, _, f = _rows(b, width, classes)
            f = scores(x, f, since, depth)
            yield pa.record_batch({"x": b.column("x"), "y": b.column("y"), "w": b.column("w"), "f": pa.array([r.tobytes() for r in f], pa.binary())})

    return held.mapInArrow(run, "x binary, y int, w double, f binary")


def _level(held: DataFrame, since: list, trees: list[Tree], level: int, depth: int, width: int, bins: int, classes: int, own: range, l2: float, least: float) -> DataFrame:
    """(k, node, column, bin, gl, hl, g, h, rows): the best split of each node of the level that has rows."""
    nodes = 1 << level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, part = {}, {}, TaskContext.get().partitionId()
        step = max(1, (1 << 22) // width)
        for b in (batch.slice(lo, step) for batch in batches for lo in range(0, batch.num_rows, step)):
            x, y, w, f = _rows(b, width, classes)
            g, h = derivatives(scores(x, f, since, depth), y, w)
            for k in own:
                node = trees[k].node(x, level)
                s = histogram(x, node, g[:, k], h[:, k], nodes, bins)
                total[k] = total[k] + s if k in total else s
                counts[k] = counts.get(k, 0) + np.bincount(node, minlength=nodes)
        out = [(k, n, c, part, int(counts[k][n]), s[n, c : c + COLUMNS].tobytes()) for k, s in total.items() for n in range(nodes) if s[n, 0, :, 1].any() for c in range(0, width, COLUMNS)]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["k", "node", "first", "part", "rows", "s"])

    def split(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        s = sum(np.frombuffer(x.as_py()) for x in t.column("s")).reshape(-1, bins, 2)
        gain, c, b, gl, hl, g, h = best_split(s, l2, least)
        first = t.column("first")[0].as_py()
        return pa.table({"k": t.column("k")[:1], "node": t.column("node")[:1], "gain": [gain], "column": pa.array([c + first if c >= 0 else -1], pa.int32()), "bin": pa.array([b], pa.int32()), "gl": [gl], "hl": [hl], "g": [g], "h": [h], "rows": pa.array([sum(t.column("rows").to_pylist())], pa.int64())})

    found = held.mapInArrow(add, "k int, node int, first int, part int, rows long, s binary").groupBy("k", "node", "first").applyInArrow(split, "k int, node int, gain double, column int, bin int, gl double, hl double, g double, h double, rows long")
    rest = F.struct("column", "bin", "gl", "hl", "g", "h", "rows")
    order = F.struct("gain", -F.col("column"))  # of equal gains the first column; columns of -1 have no gain
    return found.groupBy("k", "node").agg(F.max_by(rest, order).alias("r")).select("k", "node", "r.*")


def _lower(held: DataFrame, since: list, trees: list[Tree], level: int, depth: int, width: int, bins: int, classes: int, rate: float, l2: float, least: float) -> DataFrame:
    """(k, node, column, bin, leaf): the tree below each node of the level that has rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, step, n = TaskContext.get().partitionId(), max(1, (1 << 22) // width), 0
        for b in (batch.slice(lo, step) for batch in batches for lo in range(0, batch.num_rows, step)):
            x, y, w, f = _rows(b, width, classes)
            g, h = derivatives(scores(x, f, since, depth), y, w)
            for k in range(classes):
                node, out = trees[k].node(x, level), []
                order = np.argsort(node, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(own):
                        out.append((k, int(node[own[0]]), part, n, x[own].tobytes(), g[own, k].tobytes(), h[own, k].tobytes()))
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((*[pa.int32()] * 4, *[pa.binary()] * 3))], names=["k", "node", "part", "batch", "x", "g", "h"])
            n += 1

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("batch", "ascending")])
        x, g, h = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("x", np.uint8), ("g", float), ("h", float)))
        tree = grown(x.reshape(-1, width), g, h, depth - level, bins, rate, l2, least)
        return pa.table({"k": t.column("k")[:1], "node": t.column("node")[:1]} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("column", "bin", "leaf"), tree, strict=True)})

    return held.mapInArrow(deal, "k int, node int, part int, batch int, x binary, g binary, h binary").groupBy("k", "node").applyInArrow(grow, "k int, node int, column binary, bin binary, leaf binary")


class SoftmaxBoostingModel(Model, _Boosting):
    classes = Param(Params._dummy(), "classes", "classes", TypeConverters.toInt)
    edges = Param(Params._dummy(), "edges", "bin edges, column by column", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "edges of each column", TypeConverters.toListInt)
    columns = Param(Params._dummy(), "columns", "columns of inner nodes, tree by tree", TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "their bins", TypeConverters.toListInt)
    leaves = Param(Params._dummy(), "leaves", "leaf values, tree by tree", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, classes: int = 2, edges: list[float] = (), sizes: list[int] = (), columns: list[int] = (), cuts: list[int] = (), leaves: list[float] = ()):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def rounds(self) -> list[list[Tree]]:
        o, depth, k = self.getOrDefault, self.getOrDefault(self.depth), self.getOrDefault(self.classes)
        inner, leaf = (1 << depth) - 1, 1 << depth
        columns, cuts, leaves = np.array(o(self.columns), np.int64).reshape(-1, inner), np.array(o(self.cuts), np.int64).reshape(-1, inner), np.array(o(self.leaves)).reshape(-1, leaf)
        trees = [Tree(*t) for t in zip(columns, cuts, leaves, strict=True)]
        return [trees[i : i + k] for i in range(0, len(trees), k)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        o = self.getOrDefault
        edges = np.split(np.array(o(self.edges)), np.cumsum(o(self.sizes))[:-1])
        rounds, classes, depth = self.rounds(), o(self.classes), o(self.depth)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), dtype=object)
            some = x.notna().to_numpy()
            if some.any():
                m = np.stack(x[some].to_numpy()).astype(float)
                if m.shape[1] != len(edges):
                    raise ValueError(f"vectors of {m.shape[1]} columns, not {len(edges)}")
                out[some] = pd.Series(list(scores(binned(m, edges), np.zeros((len(m), classes)), rounds, depth)), index=out.index[some])
            return out

        df = dataset.withColumn("_raw", score(as_array(dataset, self.getFeaturesCol())))
        e = F.transform("_raw", lambda v: F.exp(v - F.array_max("_raw")))
        share = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, c: a + c))
        some = F.col("_raw").isNotNull()
        df = df.withColumn(self.getRawPredictionCol(), F.when(some, array_to_vector("_raw"))).withColumn(self.getProbabilityCol(), F.when(some, array_to_vector(share)))
        return df.withColumn(self.getPredictionCol(), (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")).drop("_raw")
