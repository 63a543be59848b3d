"""Boosting of all classes against a plain version of the same rounds, and its quality, models and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import boosting as B


def sample(n=300, d=5, classes=4, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    return x, np.where(x[:, 0] > 0.3, 0, np.where(x[:, 1] * x[:, 2] > 0, 1, rng.integers(2, classes, n)))


def frame(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), int(b), 1.0 + i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, y int, w double")


def plain(x, y, w, classes, trees, depth, bins, rate=0.3, l2=1.0, least=1e-3):
    """Scores after each tree looked for node by node, on lists of rows."""
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="inverted_cdf")) for c in x.T]
    f = np.zeros((len(x), classes))
    for _ in range(trees):
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = np.zeros_like(f)
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
            nodes = [np.arange(len(x))]
            for _ in range(depth):
                below = []
                for rows in nodes:
                    best = (1e-9, None)
                    for c in range(x.shape[1]):
                        for e in edges[c]:
                            left, right = rows[x[rows, c] <= e], rows[x[rows, c] > e]
                            if h[left].sum() >= least and h[right].sum() >= least:
                                gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                                if gain > best[0] + 1e-9:
                                    best = (gain, (left, right))
                    below += best[1] or [rows]
                nodes = below
            for rows in nodes:
                step[rows, k] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        f = f + step
    return f


@pytest.mark.parametrize(("trees", "depth"), [(1, 1), (3, 3)])
def test_rounds_against_plain(spark, trees, depth, tmp_path):
    x, y = sample()
    df = frame(spark, x, y)
    model = B.SoftmaxBoosting(trees=trees, depth=depth, bins=8, weightCol="w").fit(df.repartition(4))
    want = plain(x, y, 1.0 + np.arange(len(x)) % 3, 4, trees, depth, 8)
    out = model.transform(df).sort("row_id").collect()
    assert np.allclose([r["rawPrediction"].toArray() for r in out], want, atol=1e-8)
    assert np.allclose([r["probability"].toArray() for r in out], B.softmax(want)) and [r["prediction"] for r in out] == want.argmax(1).tolist()
    model.write().overwrite().save(str(tmp_path / "m"))
    again = B.SoftmaxBoostingModel.load(str(tmp_path / "m")).transform(df).sort("row_id").collect()
    assert [r["rawPrediction"] for r in again] == [r["rawPrediction"] for r in out]


def test_learns_and_writes_rounds(spark, monkeypatch):
    monkeypatch.setattr(B, "ROUNDS", 2)
    x, y = sample(600, 4, 3)
    df = frame(spark, x, y)
    model = B.SoftmaxBoosting(trees=5, depth=2, bins=16).fit(df.filter("row_id < 400"))
    held = model.transform(df.filter("row_id >= 400"))
    assert held.filter("prediction = y").count() / held.count() > 0.6
    monkeypatch.setattr(B, "ROUNDS", 10)
    same = B.SoftmaxBoosting(trees=5, depth=2, bins=16).fit(df.filter("row_id < 400"))
    assert np.allclose(same.getOrDefault("leaves"), model.getOrDefault("leaves"))


def test_classes_in_several_passes_and_blocks_of_columns(spark, monkeypatch):
    x, y = sample(200, 6, 4)
    df = frame(spark, x, y)
    one = B.SoftmaxBoosting(trees=2, depth=2, bins=8).fit(df)
    monkeypatch.setattr(B, "CELLS", 1)
    many = B.SoftmaxBoosting(trees=2, depth=2, bins=8).fit(df)
    assert many.getOrDefault("columns") == one.getOrDefault("columns") and np.allclose(many.getOrDefault("leaves"), one.getOrDefault("leaves"))


def test_odd_rows(spark):
    x, y = sample(100, 3, 3)
    df = frame(spark, x, y)
    odd = df.union(spark.createDataFrame([(900, None, 1, 1.0), (901, [1.0, 2.0, 3.0], None, 1.0)], df.schema)).withColumn("features", F.when(F.col("row_id") < 5, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(1.0))).otherwise(F.col("features")))
    out = {r["row_id"]: r["prediction"] for r in B.SoftmaxBoosting(trees=2).fit(odd).transform(odd).collect()}
    assert out[900] is None and out[901] in (0.0, 1.0, 2.0) and all(out[i] is not None for i in range(100))
    with pytest.raises(ValueError, match="no rows"):
        B.SoftmaxBoosting().fit(df.limit(0))
    one = df.withColumn("y", F.lit(0))
    assert {r["prediction"] for r in B.SoftmaxBoosting(trees=1).fit(one).transform(one).collect()} == {0.0}


@pytest.mark.parametrize(("alone", "node"), [(0, 1 << 17), (0, 120), (0, 0)])
def test_rounds_by_levels_and_below_nodes(spark, monkeypatch, tmp_path, alone, node):
    """A whole round in one job, upper levels in jobs of their own, and all of them: the trees are the same."""
    monkeypatch.setattr(B, "ALONE", alone)
    monkeypatch.setattr(B, "NODE", node)
    monkeypatch.setattr(B, "FILE", 100)
    test_rounds_against_plain(spark, 3, 3, tmp_path)
    test_learns_and_writes_rounds(spark, monkeypatch)
    monkeypatch.undo()
    x, y = sample(400, 6, 3)
    df = frame(spark, x, y)
    want = B.SoftmaxBoosting(trees=3, depth=4, bins=8).fit(df)
    monkeypatch.setattr(B, "ALONE", alone)
    monkeypatch.setattr(B, "NODE", node)
    got = B.SoftmaxBoosting(trees=3, depth=4, bins=8).fit(df)
    out = [[r["rawPrediction"].toArray() for r in m.transform(df).sort("row_id").collect()] for m in (want, got)]
    assert np.allclose(*out, atol=1e-8)


def test_few_jobs_a_round(spark, monkeypatch):
    monkeypatch.setattr(B, "ALONE", 0)
    x, y = sample(200, 4, 3)
    calls = []
    monkeypatch.setattr(B, "_level", lambda *a: calls.append(a))
    model = B.SoftmaxBoosting(trees=2, depth=8, bins=8).fit(frame(spark, x, y))
    assert not calls and len(model.rounds()) == 2


def test_odd_rows_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(B, "ALONE", 0)
    test_odd_rows(spark)


def test_the_leaves_query_draws_from_the_whole_space():
    from foldspark.operators import models as M
    from foldspark.plans import models as plans

    assert not plans.SMALL["boosting_leaves"] and plans.DRAWS["boosting_leaves"] > 1
    draws = M.candidates("boosting_leaves", plans.DRAWS["boosting_leaves"], 42, plans.SMALL["boosting_leaves"])
    stages = [plans.estimator("boosting_leaves", d).getStages()[-1] for d in draws]
    assert all(100 <= s.getOrDefault("trees") <= 600 and 2 ** s.getOrDefault("depth") >= d["leaves"] >= 15 for s, d in zip(stages, draws, strict=True))
