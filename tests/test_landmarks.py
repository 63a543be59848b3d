"""Landmark maps against the exact kernel, and linear machines on them against an exact kernel machine on a held-out sample."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC

from foldspark.operators import landmarks as L
from foldspark.operators import solver


def frame(spark, x, y=None):
    y = np.zeros(len(x), int) if y is None else y
    return spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, y int")


@pytest.mark.parametrize("name", L.KERNELS)
def test_all_rows_as_landmarks_are_exact(spark, name):
    x = np.random.default_rng(3).normal(size=(40, 3))
    df = frame(spark, x)
    model = L.LandmarkMap(name=name, gamma=0.5, landmarks=60).fit(df.union(df))  # copies aren't drawn twice
    points = np.array(model.getOrDefault("points")).reshape(-1, 3)
    assert len(points) <= 40 and len(np.unique(points, axis=0)) == len(points)
    z = np.stack([r["mapped"].toArray() for r in model.transform(df).sort("row_id").collect()])
    assert np.abs(z @ z.T - L.kernel(name, 0.5, x, x)).max() < 1e-3


def test_error_falls_with_landmarks_and_reruns_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) + rng.integers(0, 4, (300, 1)) * 4
    df, errors = frame(spark, x), []
    for m in (4, 30, 120):
        model = L.LandmarkMap(gamma=0.1, landmarks=m).fit(df.repartition(3))
        assert model.getOrDefault("points") == L.LandmarkMap(gamma=0.1, landmarks=m).fit(df.repartition(7)).getOrDefault("points")
        z = np.stack([r["mapped"].toArray() for r in model.transform(df).sort("row_id").collect()])
        errors.append(np.abs(z @ z.T - L.kernel("rbf", 0.1, x, x)).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.02
    groups = np.unique(np.array(L.LandmarkMap(gamma=0.1, landmarks=8).fit(df).getOrDefault("points")).reshape(-1, 4).mean(1).round() // 4)
    assert len(groups) >= 3  # spread over the groups of rows
    assert L.LandmarkMap().fit(df).getOrDefault("gamma") == pytest.approx(1 / (4 * x.var()))


def test_decisions_agree_with_the_exact_machine(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = ((x**2).sum(1) > 1.4).astype(int)  # no line parts these
    train, held = frame(spark, x[:280], y[:280]), frame(spark, x[280:], y[280:])
    pipeline = Pipeline(stages=[L.LandmarkMap(gamma=0.7, landmarks=60), LinearSVC(featuresCol="mapped", labelCol="y", regParam=1e-3, maxIter=60)])
    model = pipeline.fit(train)
    got = np.array([r["prediction"] for r in model.transform(held).sort("row_id").collect()])
    coefficients, offset = solver.fit(L.kernel("rbf", 0.7, x[:280], x[:280]), 2.0 * y[:280] - 1, 10.0)
    exact = solver.decide(L.kernel("rbf", 0.7, x[280:], x[:280]), coefficients, offset) > 0
    assert (got == exact).mean() > 0.93 and (got == y[280:]).mean() > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    assert [r["prediction"] for r in PipelineModel.load(str(tmp_path / "m")).transform(held).sort("row_id").collect()] == got.tolist()


def test_odd_rows(spark):
    df = frame(spark, np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 0.0]])).union(spark.createDataFrame([(9, None, 0)], "row_id long, features array<double>, y int"))
    for name in L.KERNELS:
        model = L.LandmarkMap(name=name, landmarks=5).fit(df)
        out = {r["row_id"]: r["mapped"] for r in model.transform(df).collect()}
        assert out[9] is None and out[0] == out[1] and len(model.getOrDefault("points")) <= 4
    with pytest.raises(ValueError, match="no rows"):
        L.LandmarkMap(gamma=1.0).fit(df.filter("row_id = 9"))
    with pytest.raises(ValueError, match="unknown"):
        L.LandmarkMap(name="x").fit(df)
