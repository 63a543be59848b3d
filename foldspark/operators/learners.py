"""Models for a table that fits a task: trees by histograms and support vector machines, over one interface.

A model is fitted by `learn(model, params, x, y, classes, seed)` and gives scores of rows, one for each class. Labels are 0 to
classes - 1. Rows weigh alike by class where the model has balanced weights.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np

from foldspark.operators import kernels, solver

BINS = 32
SMOOTH = 1.0


def balanced(y: np.ndarray) -> np.ndarray:
    """rows / (classes that occur * rows of the class), for each row."""
    found, code, n = np.unique(y, return_inverse=True, return_counts=True)
    return (len(y) / (len(found) * n))[code]


class Bins:
    """Cut points of each column, by quantiles of the training rows."""

    def __init__(self, x: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1) if x.shape[1] else np.zeros((len(x), 0), int)


class Tree:
    """Grown best split first. g: gradients, a column for each output; h: weights. A leaf's value is sum(g) / (sum(h) + smooth)."""

    def __init__(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rng, depth: int, leaves: int, least: int, columns: int, smooth: float):
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [self._leaf(g, h, smooth)]
        heap: list = []
        self._offer(heap, 0, np.arange(len(b)), 0, b, g, h, rng, depth, least, columns, smooth)
        n = 1
        while heap and n < leaves:
            _, node, rows, at, f, cut = heapq.heappop(heap)
            goes = b[rows, f] <= cut
            self.feature[node], self.cut[node], self.left[node] = f, cut, len(self.feature)
            for part in (rows[goes], rows[~goes]):
                self.feature.append(-1)
                self.cut.append(0)
                self.left.append(0)
                self.value.append(self._leaf(g[part], h[part], smooth))
                self._offer(heap, len(self.feature) - 1, part, at + 1, b, g, h, rng, depth, least, columns, smooth)
            n += 1
        self.arrays = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value)

    @staticmethod
    def _leaf(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
        return g.sum(0) / (h.sum() + smooth + 1e-12)

    @staticmethod
    def _offer(heap, node, rows, at, b, g, h, rng, depth, least, columns, smooth) -> None:
        if at >= depth or len(rows) < 2 * least:
            return
        some = np.sort(rng.permutation(b.shape[1])[:columns])
        index = (b[rows][:, some] + np.arange(len(some)) * BINS).ravel()
        size = len(some) * BINS
        sums = lambda w: np.cumsum(np.bincount(index, np.repeat(w, len(some)), size).reshape(-1, BINS), 1)
        count, weight = np.cumsum(np.bincount(index, minlength=size).reshape(-1, BINS), 1), sums(h[rows])
        gain = np.zeros((len(some), BINS))
        for k in range(g.shape[1]):
            left = sums(g[rows, k])
            total = left[:, -1:]
            gain += left**2 / (weight + smooth + 1e-12) + (total - left) ** 2 / (weight[:, -1:] - weight + smooth + 1e-12) - total**2 / (weight[:, -1:] + smooth + 1e-12)
        gain[(count < least) | (len(rows) - count < least)] = 0
        best = int(np.argmax(gain))
        if gain.flat[best] > 1e-9:
            heapq.heappush(heap, (-gain.flat[best], node, rows, at, int(some[best // BINS]), best % BINS))

    def __call__(self, b: np.ndarray) -> np.ndarray:
        feature, cut, left, value = self.arrays
        at = np.zeros(len(b), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            at[inner] = left[node] + (b[inner, feature[node]] > cut[node])


def _columns(share, n: int) -> int:
    share = {"sqrt": math.sqrt(n) / n, "log2": math.log2(max(2, n)) / n, "all": 1.0}.get(share, share)
    return max(1, min(n, round(share * n)))


def forest(params: dict, x: np.ndarray, y: np.ndarray, classes: int, seed: int) -> Callable:
    """Bagged trees with class-balanced weights; scores are mean class shares."""
    rng, bins, w = np.random.default_rng(seed), Bins(x), balanced(y)
    b, trees = bins(x), []
    for _ in range(params["trees"]):
        rows = rng.integers(0, len(x), len(x))
        g = np.eye(classes)[y[rows]] * w[rows, None]
        trees.append(Tree(b[rows], g, w[rows], rng, params["depth"], len(x), params["least"], _columns(params["columns"], x.shape[1]), 0.0))
    return lambda z: np.mean([t(bins(z)) for t in trees], 0)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def boosting(params: dict, x: np.ndarray, y: np.ndarray, classes: int, seed: int) -> Callable:
    """Trees on the gradient of the log loss, class-balanced, one a class and round (one a round for two classes)."""
    rng, bins, w = np.random.default_rng(seed), Bins(x), balanced(y)
    b, trees = bins(x), []
    outputs = 1 if classes == 2 else classes
    one = (y[:, None] == 1).astype(float) if outputs == 1 else np.eye(classes)[y]
    score = np.zeros((len(x), outputs))
    chance = lambda s: 1 / (1 + np.exp(-s)) if outputs == 1 else softmax(s)
    for _ in range(params["trees"]):
        p = chance(score)
        rows = np.flatnonzero(rng.random(len(x)) < params["rows"]) if params["rows"] < 1 else np.arange(len(x))
        step = []
        for k in range(outputs):
            g, h = w[rows] * (one[rows, k] - p[rows, k]), w[rows] * p[rows, k] * (1 - p[rows, k])
            t = Tree(b[rows], g[:, None], h, rng, params.get("depth", 64), params.get("leaves", len(x)), 1, _columns(params["columns"], x.shape[1]), SMOOTH)
            score[:, k] += params["rate"] * t(b)[:, 0]
            step.append(t)
        trees.append(step)

    def scores(z: np.ndarray) -> np.ndarray:
        c = bins(z)
        s = params["rate"] * sum((np.stack([t(c)[:, 0] for t in step], 1) for step in trees), np.zeros((len(z), outputs)))
        p = chance(s)
        return np.hstack([1 - p, p]) if outputs == 1 else p

    return scores


def margins(k: np.ndarray, y: np.ndarray, classes: int, settings: list[tuple[float, str | None]]) -> list[list[tuple[np.ndarray, float]]]:
    """For each (c, weights): coefficients and offset on a Gram table, of class 1 for two classes, else of each class against the
    rest. All machines are solved side by side."""
    ones = [1] if classes == 2 else list(range(classes))
    signs, tops = [], []
    for c, weights in settings:
        for one in ones:
            sign = np.where(y == one, 1.0, -1.0)
            share = {s: len(y) / (2 * max(1, int(np.sum(sign == s)))) if weights else 1.0 for s in (-1, 1)}
            signs.append(sign)
            tops.append(c * np.where(sign > 0, share[1], share[-1]))
    a, b = solver.fit_many(k, np.stack(signs), np.stack(tops))
    b = np.where((np.stack(signs) > 0).all(1), 1.0, np.where((np.stack(signs) < 0).all(1), -1.0, b))  # one label only
    each = list(zip(a, b.tolist(), strict=True))
    return [each[i : i + len(ones)] for i in range(0, len(each), len(ones))]


def decisions(k: np.ndarray, fitted: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Scores by class from kernels with the training rows: both signs of the margin for two classes, else a softmax of margins."""
    d = np.stack([solver.decide(k, a, b) for a, b in fitted], 1)
    return np.hstack([-d, d]) if d.shape[1] == 1 else softmax(d)


def rbf_svm(params: dict, x: np.ndarray, y: np.ndarray, classes: int, seed: int) -> Callable:
    fitted = margins(kernels.rbf(x, x, params["gamma"]), y, classes, [(params["c"], params["weights"])])[0]
    return lambda z: decisions(kernels.rbf(z, x, params["gamma"]), fitted)


MODELS: dict[str, Callable] = {"random_forest": forest, "boosting_depth": boosting, "boosting_leaves": boosting, "svm": rbf_svm}


def learn(model: str, params: dict, x: np.ndarray, y: np.ndarray, classes: int, seed: int = 42) -> Callable:
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    return MODELS[model](params, x, y, classes, seed)


class Chain:
    """Variance filter, greedy correlation filter, standardisation and principal components, learned from training rows only."""

    def __init__(self, x: np.ndarray, components: int | None = None, correlation: float = 0.95, variance: float = 0.0):
        self.keep = np.flatnonzero(x.var(0) > variance)
        z = x[:, self.keep]
        r = np.nan_to_num(np.corrcoef(z, rowvar=False)).reshape(z.shape[1], z.shape[1]) if len(self.keep) else np.zeros((0, 0))
        dropped = np.zeros(len(self.keep), bool)
        for i in range(len(self.keep)):
            if not dropped[i]:
                dropped[i + 1 :] |= np.abs(r[i, i + 1 :]) > correlation
        self.keep = self.keep[~dropped]
        z = x[:, self.keep]
        self.mean, sd = z.mean(0), z.std(0)
        self.sd = np.where(sd > 0, sd, 1)
        self.axes, self.explained = None, None
        if components is not None:
            if components > min(z.shape):
                raise ValueError(f"{components} components of {z.shape[1]} features and {z.shape[0]} rows")
            _, s, axes = np.linalg.svd((z - self.mean) / self.sd, full_matrices=False)
            largest = axes[np.arange(len(axes)), np.argmax(np.abs(axes), 1)]
            self.axes, self.explained = (axes * np.sign(largest)[:, None])[:components], (s**2 / max((s**2).sum(), 1e-300))[:components]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, self.keep] - self.mean) / self.sd
        return z if self.axes is None else z @ self.axes.T
