import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldspark.functions import scalars as S
from foldspark.operators import geometry as G
from foldspark.operators import labelstats as L
from foldspark.operators import metrics as M
from foldspark.operators import models
from foldspark.operators import runstore as R
from foldspark.operators import sampling as P
from foldspark.operators import stats as T
from foldspark.operators.ordered import rank_auc
from foldspark.sources import tables
from foldspark.streaming import labelstats as stream


def test_folds_part_all_rows_alike_for_any_partitioning(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 20, "a").when(F.col("id") < 32, "b").otherwise("c").alias("y"))
    one = {(r["id"], r["fold"]) for r in P.folds(df, "y", "id", 5).collect()}
    assert one == {(r["id"], r["fold"]) for r in P.folds(df.repartition(7), "y", "id", 5).collect()}
    assert len(one) == 40
    n = P.folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    for y in "abc":
        counts = [r["count"] for r in n if r["y"] == y]
        assert max(counts) - min(counts) <= 1


def test_subsample_and_balanced_pool(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    s = P.subsample(df, "y", "id", 100)
    assert sorted(r["count"] for r in s.groupBy("y").count().collect()) == [10, 90]
    assert P.subsample(df, "y", "id", 5000).count() == 1000
    families = spark.createDataFrame([(i, f) for i, f in enumerate("aaaaaabbbbcc")], "id long, f string")
    assert {(r["f"], r["count"]) for r in P.balanced(families, "f", "id", 3, 15).groupBy("f").count().collect()} == {("a", 4), ("b", 4)}
    assert {r["f"] for r in P.balanced(families, "f", "id", 1, 1).collect()} == {"a"}


def test_scalars(spark):
    row = spark.range(1).select(
        S.binary_label(F.lit("  MALWARE "), "malware").alias("y"), S.prefix(F.lit("A-x-1"), 2).alias("two"), S.prefix(F.lit("Benign"), 2).alias("one"),
        S.minmax(F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("flat"), S.minmax(F.lit(9.0), F.lit(0.0), F.lit(4.0), 1.0).alias("clip"),
        S.pad_normalize(F.array(F.lit(3.0), F.lit(4.0)), 4).alias("pad"), S.pad_normalize(F.array(F.lit(0.0)), 2).alias("zero"),
        S.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("soft"), S.l1_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("l1"),
        *[S.sample_size(F.lit(b), 400, 11.4, 2.0).alias(f"n{i}") for i, b in enumerate((45.6, 11.4, 2.85))],
    ).first()
    assert (row["y"], row["two"], row["one"], row["flat"], row["clip"]) == (1, "A-x", "Benign", 0.0, 1.0)
    assert row["pad"] == [0.6, 0.8, 0.0, 0.0] and row["zero"] == [0.0, 0.0] and row["soft"] == [0.5, 0.5] and row["l1"] == [0.0, 0.0]
    assert [row["n0"], row["n1"], row["n2"]] == [800, 400, 200]
    with pytest.raises(PySparkException):
        spark.range(1).select(S.sample_size(F.lit(0.0), 400, 11.4, 2.0)).collect()


def test_constant_column_has_no_correlation(spark):
    assert spark.range(5).agg(S.correlation(F.col("id").cast("double"), F.lit(3.0)).alias("r")).first()["r"] == 0.0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 1), (1, 1)], "y int, p int")
    s = M.summary(M.confusion(df)).first()
    assert s["accuracy"] == pytest.approx(5 / 7)
    assert s["f1_macro"] == pytest.approx((2 * 2 / 6 + 2 * 3 / 8) / 2)
    assert M.matthews(M.confusion(df.filter("y = 0 and p = 0"))).first()["mcc"] == 0.0
    k = {r["label"]: r["f1"] for r in M.per_class(M.confusion(df), spark.createDataFrame([(0,), (1,), (7,)], "label int")).collect()}
    assert k[7] == 0.0
    auc = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "y int, s double")
    assert rank_auc(auc, [], "s", "y").first()["auc"] == pytest.approx(3.5 / 4)
    assert rank_auc(auc.filter("y = 1"), [], "s", "y").first()["auc"] is None


def test_mcnemar_orientation(spark):
    df = spark.createDataFrame([(1, 1, 0)] * 7 + [(1, 0, 0)], "y int, a int, b int")
    r = T.mcnemar_counts(df, "y", "a", "b").first()
    assert (r["n01"], r["n10"], r["statistic"]) == (0, 7, 0)


def runs(spark, parents, children):
    return spark.createDataFrame(parents, "run_id string, status string, start_time string, cell string"), spark.createDataFrame(children, "parent_run_id string, f1_macro double")


def test_clean_sweeps(spark):
    p, c = runs(spark, [("a", "FINISHED", "1", "x"), ("b", "RUNNING", "2", "x"), ("c", "FINISHED", "3", "x"), ("d", "FINISHED", "4", "x")],
                [("a", 0.1)] * 2 + [("b", 0.2)] * 2 + [("c", 0.3)] + [("d", 0.4), ("d", None)] + [("gone", 0.5)] * 2)
    assert [r["parent_run_id"] for r in R.clean_sweeps(c, p, 2).collect()] == ["a"]
    assert R.newest(p, "cell").first()["run_id"] == "d"
    with pytest.raises(ValueError, match="start_time"):
        R.require(c.withColumnsRenamed({"parent_run_id": "run_id"}))


def test_aligned_predictions(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0)], "row_id long, y int, pred int")
    b = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, 1, 1)], "row_id long, y int, pred int")
    assert [tuple(r) for r in R.aligned(a, b).collect()] == [(2, 1, 1, 0)]
    assert tuple(R.alignment_report(a, b).first()) == (1, 1, 2, 1)


def test_dominant_tag_ties_and_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 2, 0), (2, 0, 0, 0), (3, 0, 1, 5)], "id long, adware long, worm long, packed long")
    tags = ["adware", "worm", "packed"]
    assert {r["id"]: r["dominant_tag"] for r in L.dominant(df, tags).collect()} == {1: "adware", 3: "packed"}
    assert tuple(L.stats(df, tags).first()) == (3, 1, 2, 1)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    q = stream.write_parts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), tags, f"{tmp_path}/parts", f"{tmp_path}/check")
    q.awaitTermination(60)
    assert tuple(stream.read_total(spark, f"{tmp_path}/parts").first()) == (3, 1, 2, 1)


def test_geometry(spark):
    rows = [(float(x), 0.0, 0) for x in range(10)] + [(float(x), 100.0, 1) for x in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    assert all(r["fisher"] > 100 for r in G.fisher(G.class_moments(df, "y", ["a", "b"])).collect())
    v = df.select("y", F.array("a", "b").alias("x"))
    assert {(r["a"], r["b"]): r["distance"] for r in G.centroid_distances(v, "y", "x").collect()}[0, 1] == pytest.approx(100)
    assert G.silhouette(v.withColumn("i", F.col("x")[0].cast("long") + 100 * F.col("y")), "i", "x", "y").first()["silhouette"] > 0.9
    drift = G.proportion_drift(df, df.filter("y = 0"), "y").first()
    assert (drift["n_classes"], drift["max_abs_diff"]) == (2, 0.5)
    long = spark.createDataFrame([("f", 1.0, 1), ("f", 1.0, 1), ("f", 3.0, 0), ("k", 2.0, 1), ("k", 2.0, 0)], "feature string, x double, s int")
    d = G.feature_drift(long).first()
    assert (d["constant_full"], d["constant_sample"], d["max_std_ratio_dev"]) == (1, 2, 1.0)


def test_sources(spark, tmp_path):
    (tmp_path / "folds.json").write_text(json.dumps([{"train": [1, 2], "test": [0]}, {"train": [0], "test": [1, 2]}]))
    (tmp_path / "sample.json").write_text(json.dumps([5, 3, 9]))
    assert {(r["fold"], r["row_id"]) for r in tables.read_fold_lists(spark, str(tmp_path / "folds.json")).collect()} == {(0, 0), (1, 1), (1, 2)}
    assert [r["row_id"] for r in tables.read_sample(spark, str(tmp_path / "sample.json")).orderBy("sample_pos").collect()] == [5, 3, 9]
    df = spark.createDataFrame([(1.0, 2, "a")], "f double, label int, Class string")
    assert tables.features(df) == ["f"]
    with pytest.raises(ValueError, match="Category"):
        tables.without(df, "Category")
    p = spark.createDataFrame([("m", "t", 1, 0, 1)], "model string, task string, n_components int, y int, y_pred int")
    tables.write_predictions(p, str(tmp_path / "p"))
    tables.write_predictions(p.withColumn("n_components", F.lit(2)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_kernel_model_scores_each_row_once(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i % 2) * 3 + (i % 5) * 0.1, float(i % 3)]) for i in range(40)], "row_id long, y int, x array<double>")
    r = models.kernel_cross_validate(rows, ["iqp", "amplitude"], [0.5]).collect()
    assert sorted(x["row_id"] for x in r) == list(range(40))
    assert sum(x["y"] == x["y_pred"] for x in r) > 30


def test_projection_shares(spark):
    rows = spark.createDataFrame([([float(i), 2.0 * i, float(i % 3)],) for i in range(30)], "v array<double>")
    p, shares = models.project(rows, "v", 2)
    assert p.count() == 30 and shares[0] > 0.98 and sum(shares) <= 1 + 1e-9
