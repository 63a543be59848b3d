"""Kernel sums by moments against all pairs."""

from functools import partial

import numpy as np
import pytest

from foldspark.operators import kernels as K
from foldspark.operators import moments as M


def plain(x, y):
    u = M.unit(np.array(x, float))
    k = (u @ u.T) ** 2
    i, j = np.triu_indices(len(x), 1)
    same = np.array([a is not None and a == b for a in y for b in y]).reshape(len(y), -1)
    return len(i), k[i, j].sum(), (k[i, j] ** 2).sum(), (k * same)[i, j].sum()


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_sums_of_all_pairs(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(200, d)).tolist() + [[0.0] * d] * 3
    y = [None if v == 3 else int(v) for v in rng.integers(0, 4, len(x))]
    df = spark.createDataFrame(list(zip(range(len(x)), x, y, strict=True)), "i long, x array<double>, y int")
    want = plain(x, y)
    for parts in (1, 7):
        got = M.moment_sums(df.repartition(parts)).first()
        assert got["n"] == want[0] and tuple(got)[1:] == pytest.approx(want[1:], rel=1e-9, abs=1e-9)
    blocks = K.kernel_sums(df.na.fill(-1, ["y"]), partial(K.fidelity, encoding="amplitude")).first()
    assert tuple(blocks)[:3] == pytest.approx(want[:3], rel=1e-9)
    assert tuple(M.sums(df.na.fill(-1, ["y"]), d).first())[:3] == pytest.approx(want[:3], rel=1e-9)


def test_orders_count_all_entries():
    for d in (1, 3, 6):
        assert M.second_orders(d).sum() == d**2
        assert sum(M.fourth_orders(d, s).sum() for s in range(d)) == d**4


def test_null_vectors_no_rows_and_odd_lengths(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [1.0, 1.0], "a"), (4, [2.0, 0.0], "b")], "i long, x array<double>, y string")
    assert tuple(M.moment_sums(df).first()) == pytest.approx((3, 2.0, 1.5, 0.5))
    assert tuple(M.moment_sums(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0)
    assert tuple(M.moment_sums(df.limit(1)).first()) == pytest.approx((0, 0.0, 0.0, 0.0))
    with pytest.raises(Exception, match="different lengths"):
        M.moment_sums(df.union(spark.createDataFrame([(5, [1.0], "a")], df.schema)).coalesce(1)).collect()


def test_time_follows_rows(spark):
    """No stage makes more rows than a constant number for each task, however many pairs there are."""
    df = spark.range(20_000).selectExpr("id AS i", "array(sin(id), cos(id), sin(3 * id)) AS x", "id % 3 AS y")
    n = M.tensors(df.repartition(8)).count()
    assert n == 3 + 3
