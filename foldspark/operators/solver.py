"""A support vector machine on a precomputed kernel: two variables a step, those that violate optimality most."""

from __future__ import annotations

import numpy as np


def fit_many(k: np.ndarray, y: np.ndarray, top: np.ndarray, tolerance: float = 1e-3, steps: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Signed coefficients (a row for each machine) and offsets of several machines on one Gram table, solved side by side.

    y: labels -1 and 1 by machine and row; top: the largest coefficient of each. Each step of a machine moves the row that
    violates optimality most and the one that gains most with it. A machine that has met the tolerance rests.
    """
    y, top = np.asarray(y, float), np.asarray(top, float)
    out, offsets = np.zeros(y.shape), np.zeros(len(y))
    diagonal, live = k.diagonal(), np.arange(len(y))
    s, w, a = y.copy(), top.copy(), np.zeros(y.shape)
    v = s.copy()  # labels less scores
    up = np.where(s > 0, 0.0, -np.inf)  # 0 where a row's coefficient can move up
    low = np.where(s > 0, np.inf, 0.0)  # 0 where it can move down
    rows = np.arange(len(live))
    for step in range(steps + 1):
        i = (v + up).argmax(1)
        high, least = v[rows, i] + up[rows, i], (v + low).min(1)
        done = ~(high - least >= tolerance) if step < steps else np.ones(len(live), bool)
        if done.any():
            free = (a > 0) & (a < w)
            ends = np.stack([high, least])
            middle = np.where(np.isfinite(ends), ends, 0).sum(0) / np.maximum(np.isfinite(ends).sum(0), 1)
            n = free.sum(1)
            offsets[live[done]] = np.where(n > 0, np.where(free, v, 0).sum(1) / np.maximum(n, 1), middle)[done]
            out[live[done]] = (a * s)[done]
            go = ~done
            live, s, w, a, v, up, low, i, high = live[go], s[go], w[go], a[go], v[go], up[go], low[go], i[go], high[go]
            rows = np.arange(len(live))
            if not len(live):
                break
        ki = k[i]
        gap = high[:, None] - (v + low)
        bend = np.maximum(diagonal[i][:, None] + diagonal - 2 * ki, 1e-12)
        j = (np.maximum(gap, 0) ** 2 / bend).argmax(1)
        size = gap[rows, j] / bend[rows, j]
        size = np.minimum(size, np.where(s[rows, i] > 0, w[rows, i] - a[rows, i], a[rows, i]))
        size = np.minimum(size, np.where(s[rows, j] > 0, a[rows, j], w[rows, j] - a[rows, j]))
        a[rows, i] += s[rows, i] * size
        a[rows, j] -= s[rows, j] * size
        v -= size[:, None] * (ki - k[j])
        for x in (i, j):
            t, b, positive = a[rows, x], w[rows, x], s[rows, x] > 0
            up[rows, x] = np.where(np.where(positive, t < b, t > 0), 0.0, -np.inf)
            low[rows, x] = np.where(np.where(positive, t > 0, t < b), 0.0, np.inf)
    return out, offsets


def fit(k: np.ndarray, y: np.ndarray, c: float = 1.0, weights: dict[int, float] | None = None, tolerance: float = 1e-3, steps: int = 100_000) -> tuple[np.ndarray, float]:
    """Signed coefficients and offset for labels -1 and 1. weights: a factor of c for each label."""
    y = np.asarray(y, float)
    top = c * np.where(y > 0, (weights or {}).get(1, 1.0), (weights or {}).get(-1, 1.0))
    a, b = fit_many(k, y[None], top[None], tolerance, steps)
    return a[0], float(b[0])


def decide(k: np.ndarray, coefficients: np.ndarray, offset: float) -> np.ndarray:
    """Scores of rows from their kernels with the training rows."""
    return k @ coefficients + offset


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    scores = []
    for c in np.union1d(y, p):
        both = np.sum((y == c) & (p == c))
        scores.append(2 * both / max(np.sum(y == c) + np.sum(p == c), 1))
    return float(np.mean(scores))
