"""Machines side by side: against the exact kernel machine, and over more rows than a Gram table holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import kernels as K
from foldspark.operators import machines as H
from foldspark.operators import models, solver


@pytest.mark.parametrize("encoding", ["angle", "iqp", "amplitude"])
def test_densities_are_the_kernel(encoding):
    x, y = np.random.default_rng(0).normal(size=(2, 30, 3))
    assert np.allclose(H.densities(x, encoding, 0.7) @ H.densities(y, encoding, 0.7).T, K.fidelity(x, y, encoding, 0.7))


def test_loss_is_near_the_exact_machines():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    sign = np.where(x[:, 0] + 0.5 * rng.normal(size=300) > 0, 1.0, -1.0)[:, None]
    z = np.column_stack([H.densities(x, "iqp"), np.ones(300)])
    a, b = solver.fit(K.fidelity(x, x, "iqp"), sign[:, 0], 1.0)
    loss = lambda w, b: ((w**2).sum() / 2 + np.maximum(0, 1 - sign[:, 0] * (z[:, :-1] @ w + b)).sum()) / 300
    penalty = np.append(np.full(z.shape[1] - 1, 1 / 300), 0.0)[None]
    w = H.minimise(lambda w: H.hinge(z, sign, np.full((300, 1), 1 / 300), w), penalty, 60, 60)[0]
    assert loss(w[:-1], w[-1]) < 1.05 * loss(z[:, :-1].T @ a, b)


def test_one_against_the_rest(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 3)) * 0.3 + np.eye(3)[y] * 3 + 100
    x = np.column_stack([x, np.ones(300)])
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)] + [(None, 1)], "features array<double>, label int")
    p = H.HingeMachines(maxIter=15, regParam=1e-3).fit(df).transform(df).collect()
    assert sum(r["prediction"] == r["label"] for r in p) > 290 and p[-1]["prediction"] is None and len(p[0]["rawPrediction"]) == 3


@pytest.mark.parametrize("classes", [2, 3])
def test_kernel_machine_beyond_a_gram_table(spark, monkeypatch, classes):
    monkeypatch.setattr(models, "GRAM_ROWS", 50)
    rng = np.random.default_rng(classes)
    y = rng.integers(0, classes, 120)
    x = rng.normal(size=(120, 3)) * 0.3 + np.eye(3)[y]
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y int")
    got = models.state_cross_validate(rows, ["iqp", "amplitude"], [0.5], 2, passes=15).collect()
    assert sorted(r["row_id"] for r in got) == list(range(120)) and all(len(r["scores"]) == classes for r in got)
    assert sum(r["y"] == r["y_pred"] for r in got) > 90
    want = {r["row_id"]: r["fold"] for r in models.folds(rows, "y", "row_id", 2).collect()}
    assert all(want[r["row_id"]] == r["fold"] for r in got)
    probe = models.state_timing_probe(rows.withColumn("x", F.slice("x", 1, 2)), "angle").first()
    n = 120 - probe["n_test"]
    assert probe["kernel_evals"] == n * (n - 1) // 2 + probe["n_test"] * n and min(probe["build_seconds"], probe["fit_seconds"], probe["infer_seconds"]) > 0
