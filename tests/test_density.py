"""Kernel sums from tensors of states against all pairs."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import density as D
from foldspark.operators import kernels as K
from foldspark.plans import kernels as plans


def frame(spark, n, q):
    x = np.random.default_rng(q).normal(size=(n, q))
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "i long, x array<double>, y int"), x


@pytest.mark.parametrize("q", [1, 2, 3, 6])
@pytest.mark.parametrize("encoding", ["angle", "iqp"])
def test_tensors_against_all_pairs(spark, monkeypatch, q, encoding):
    monkeypatch.setattr(D, "CHUNK", 60)
    monkeypatch.setattr(D, "ROWS", 16)
    monkeypatch.setattr(D, "MEET", 2)
    rows, x = frame(spark, 200, q)
    k = K.fidelity(x, x, encoding, 0.7)[np.triu_indices(200, 1)]
    got = D.tensor_sums(rows, q, encoding, 0.7).first()
    assert tuple(got) == pytest.approx((len(k), k.sum(), (k**2).sum()), rel=1e-10)
    blocks = K.kernel_sums(rows, partial(K.fidelity, encoding=encoding, bandwidth=0.7)).select("n", "k1", "k2").first()
    assert tuple(D.sums(rows, q, encoding, 0.7).first()) == pytest.approx(tuple(blocks), rel=1e-10)


def test_few_rows_and_null_vectors(spark):
    rows, _ = frame(spark, 2, 2)
    odd = rows.union(rows.limit(1).select(F.lit(9).cast("long"), F.lit(None).cast("array<double>"), "y"))
    assert D.tensor_sums(odd, 2, "iqp").first()["n"] == 1
    assert tuple(D.tensor_sums(odd.filter("i = 9"), 2, "iqp").first()) == (0, 0.0, 0.0)


def test_many_rows_meet_no_pairs(spark, monkeypatch):
    """The query on six qubits leaves pairs for tensors where rows are many, and its figures stay."""
    few = plans.kernel_state_gram_nq(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(D, "NEAR", 100)
    monkeypatch.setattr(K, "pairs", None)
    many = plans.kernel_state_gram_nq(spark, "/root/testdata/sf0.001").collect()
    assert [r["n_pairs"] for r in many] == [r["n_pairs"] for r in few] == [500 * 499 // 2] * 2
    assert [r["offdiag_std"] for r in many] == pytest.approx([r["offdiag_std"] for r in few], abs=1e-10)
