"""Sums of phases against all pairs."""

import numpy as np
import pytest

from foldspark.operators import moments as M
from foldspark.operators import phases as P


@pytest.mark.parametrize("x", [np.random.default_rng(0).normal(size=300) * 3 + 7, np.append(np.random.default_rng(1).normal(size=200), [1e4, -500.0]), np.array([2.0, 2.0]), np.array([])])
def test_sums_of_all_pairs(spark, x):
    y = [None if k % 7 == 0 else k % 3 for k in range(len(x))]
    df = spark.createDataFrame([(float(v), c) for v, c in zip(x, y, strict=True)] + [(None, 1)], "x double, y int")
    i, j = np.triu_indices(len(x), 1)
    t = x[i] - x[j]
    for g in (0.3, 1 / max(x.var(), 1e-3) if len(x) else 1.0):
        k = np.exp(-g * t**2)
        assert tuple(P.gaussian_sums(df, "x", g).first()) == pytest.approx((len(t), k.sum(), (k**2).sum()), rel=1e-9, abs=1e-9)
    same = np.array([y[a] is not None and y[a] == y[b] for a, b in zip(i, j, strict=True)], bool)
    for r in P.iqp_sums(df, "x", "y", (0.25, 2.0)).collect() if len(x) else []:
        k = np.cos(r["bandwidth"] * t / 2) ** 2
        assert tuple(r)[1:] == pytest.approx((len(t), k.sum(), (k**2).sum(), k[same].sum()), rel=1e-9, abs=1e-9)


def test_mean_similarity(spark):
    x = np.random.default_rng(2).normal(size=(150, 5))
    x[3] = 0
    df = spark.createDataFrame([(k, v.tolist(), k % 4) for k, v in enumerate(x)], "i long, x array<double>, y int")
    u = M.unit(x)
    got = {r["i"]: r["k_mean"] for r in M.mean_similarity(df).collect()}
    assert [got[k] for k in range(150)] == pytest.approx(((u @ u.T) ** 2).mean(1).tolist(), abs=1e-12)
    assert M.mean_similarity(df.limit(0)).count() == 0
