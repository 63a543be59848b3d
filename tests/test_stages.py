"""Pipeline stages against plain numpy, saved and loaded, and searched over by folds."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from foldspark.operators import stages as S


def sample(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(1000, [1, 5, 0.1, 2], (n, 4))
    return np.column_stack([x[:, 0], np.full(n, 7.0), x[:, 0] * 2 + 1e-3 * x[:, 1], x[:, 1], x[:, 2] - x[:, 3]]), rng.integers(0, 3, n)


def frame(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, features array<double>, y int")


@pytest.mark.parametrize("components", [0, 2])
def test_chain_against_numpy(spark, components, tmp_path):
    x, y = sample()
    df = frame(spark, x, y)
    model = S.FeatureChain(components=components).fit(df.repartition(5))
    assert model.getOrDefault("kept") == [0, 3, 4]  # 1 is constant, 2 goes with 0
    z = (x[:, [0, 3, 4]] - x[:, [0, 3, 4]].mean(0)) / x[:, [0, 3, 4]].std(0)
    if components:
        values, axes = np.linalg.eigh(np.corrcoef(z.T))
        axes = axes[:, np.argsort(-values)[:2]]
        z = z @ (axes * np.sign(axes[np.abs(axes).argmax(0), range(2)]))
        assert model.getOrDefault("explained") == pytest.approx(sorted(values / 3)[::-1][:2])
    got = {r["row_id"]: r["scaled"].toArray() for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], z, atol=1e-6)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = S.FeatureChainModel.load(str(tmp_path / "m"))
    vectors = df.withColumn("features", array_to_vector("features"))  # vectors do as well as arrays
    assert np.allclose([r["scaled"].toArray() for r in again.transform(vectors).sort("row_id").collect()], z, atol=1e-6)
    with pytest.raises(ValueError, match="9 components of 3"):
        S.FeatureChain(components=9).fit(df)


def test_nulls_no_rows_and_odd_lengths(spark):
    x, y = sample(30)
    df = frame(spark, x, y).union(spark.createDataFrame([(99, None, 0)], "row_id long, features array<double>, y int"))
    model = S.FeatureChain().fit(df)
    out = {r["row_id"]: r["scaled"] for r in model.transform(df).collect()}
    assert out[99] is None and len(out[0]) == 3
    with pytest.raises(ValueError, match="no rows"):
        S.FeatureChain().fit(df.limit(0))
    with pytest.raises(Exception, match="not 5"):
        model.transform(df.select("row_id", F.slice("features", 1, 3).alias("features"))).collect()


def test_greedy_filter_follows_column_order():
    rng = np.random.default_rng(2)
    for _ in range(50):
        r = np.corrcoef(rng.normal(size=(6, 4)) @ rng.normal(size=(4, 8)), rowvar=False)
        want, gone = [], set()
        for i in range(8):
            for j in range(i + 1, 8):
                if i not in gone and j not in gone and abs(r[i, j]) > 0.6:
                    gone.add(j)
        want = [i not in gone for i in range(8)]
        assert S.greedy_kept(r, 0.6).tolist() == want


def test_wide_tables(spark):
    """2,381 columns: no list of pairs, a matrix of columns times columns at most."""
    df = spark.range(60).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), F.lit(2381)), lambda i: F.sin(F.col("id") * i)).alias("features"))
    model = S.FeatureChain(correlation=0.999).fit(df)
    assert 20 < len(model.getOrDefault("kept")) < 2381 and model.getOrDefault("width") == 2381
    assert len(model.transform(df).first()["scaled"]) == len(model.getOrDefault("kept"))


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 0.0), (2, 2.0)], "y int, prediction double")
    assert S.MacroF1().evaluate(df) == pytest.approx((0.8 + 0 + 1) / 3) and S.MacroF1().isLargerBetter()
    assert S.MacroF1().evaluate(df.limit(0)) == 0.0


def test_search_in_folds_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 3)) + np.stack([y * 1.5, 0 * y, 0 * y], 1)
    df = frame(spark, x, y)
    chain, last = S.FeatureChain(outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="y")
    pipeline = Pipeline(stages=[chain, last])
    grid = ParamGridBuilder().addGrid(last.regParam, [0.01, 100.0]).addGrid(chain.components, [0, 1]).build()
    out = S.nested(df, pipeline, grid, k=3, inner=2, path=str(tmp_path / "models"))
    assert out.count() == 200 and out.select("row_id").distinct().count() == 200
    assert S.MacroF1().evaluate(out) > 0.65
    for k in range(3):
        model = PipelineModel.load(str(tmp_path / f"models/fold={k}"))
        held = out.filter(F.col("fold") == k)
        again = model.transform(held.select("row_id", "features", "y"))
        assert sorted(map(tuple, again.select("row_id", "prediction").collect())) == sorted(map(tuple, held.select("row_id", "prediction").collect()))
        assert model.stages[-1].getOrDefault("regParam") == 0.01
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid[:2], evaluator=S.MacroF1(), numFolds=2, foldCol="inner")
    fitted = search.fit(df.withColumn("inner", (F.col("row_id") % 2).cast("int")))
    fitted.write().overwrite().save(str(tmp_path / "cv"))
    assert CrossValidatorModel.load(str(tmp_path / "cv")).avgMetrics == pytest.approx(fitted.avgMetrics)


def test_held_out_rows_dont_change_the_fit(spark):
    x, y = sample(90)
    df = frame(spark, x, y)
    p = Pipeline(stages=[S.FeatureChain(), NaiveBayes(modelType="gaussian", featuresCol="scaled", labelCol="y")])
    a = S.nested(df, p, [], k=3).filter("fold = 0").sort("row_id").collect()
    held = [r["row_id"] for r in a]
    wild = df.withColumn("features", F.when(F.col("row_id").isin(held), F.transform("features", lambda v: v * 1000)).otherwise(F.col("features")))
    b = S.nested(wild, p, [], k=3).filter("fold = 0").sort("row_id").collect()
    for r, s in zip(a, b, strict=True):
        u = np.array(r["features"])[[0, 3, 4]]
        assert np.allclose((np.array(s["scaled"]) - np.array(r["scaled"])) / (999 * u), (np.array(b[0]["scaled"]) - np.array(a[0]["scaled"])) / (999 * np.array(a[0]["features"])[[0, 3, 4]]))
