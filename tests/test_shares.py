"""Steps whose work or memory grew with more than a task's share."""

import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from foldspark.functions import scalars as S
from foldspark.operators import hashing as H
from foldspark.operators import runstore as R
from foldspark.operators import sampling
from foldspark.operators.stages import FeatureChain, nested
from foldspark.sources import tables
from tests.plain_vectors import murmur3


def test_fold_lists_in_lines(spark, tmp_path):
    want = [(k, k % 3) for k in range(500)]
    tables.write_fold_lines(spark.createDataFrame(want, "row_id long, fold int"), str(tmp_path / "f"), rows=50)
    assert spark.read.text(str(tmp_path / "f")).count() > 5
    got = tables.read_folds(spark, str(tmp_path / "f"), lines=True)
    assert sorted((r["row_id"], r["fold"]) for r in got.filter("part = 'test'").collect()) == want
    assert sorted((r["row_id"], r["fold"]) for r in got.filter("part = 'train'").collect()) == sorted((i, k) for i, f in want for k in range(3) if k != f)
    (tmp_path / "bad.json").write_text('[{"train": [1], "test": [2]}]\n[{"train": [3], "test": [3]}]\n')
    with pytest.raises(Exception, match="both lists"):
        tables.read_folds(spark, str(tmp_path / "bad.json"), lines=True).collect()


def test_softmax_takes_the_maximum_once(spark):
    p = spark.createDataFrame([([1.0, 2.0, 1000.0],), ([],), (None,)], "s array<double>").select(S.softmax(F.col("s")).alias("p"))
    assert [r["p"] for r in p.collect()] == [[0.0, 0.0, 1.0], [], None]
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max") == 1 and "array(array_max(" in plan


def test_bins_of_few_and_many_entries_agree(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "a", None],), ([],), (None,), ([str(k) for k in range(40)],)], "t array<string>")
    few = [list(r[0]) for r in df.select(H.hash_tokens("t", 128)).collect()]
    assert "array_contains" in H.hashed("t", 128)
    monkeypatch.setattr(H, "FEW", -1)
    assert few == [list(r[0]) for r in df.select(H.hash_tokens("t", 128)).collect()]


def test_a_cell_may_be_named_by_its_sweeps(spark):
    children = spark.createDataFrame([(p, k, 0.1 * k) for p in (1, 2, 3) for k in range(2 if p < 3 else 1)], "parent_run_id long, start_time long, f1_macro double")
    parents = spark.createDataFrame([(1, "FINISHED", 5, "a"), (2, "FINISHED", 4, "a"), (3, "FINISHED", 9, "a"), (4, "FINISHED", 9, "b")], "run_id long, status string, start_time long, cell string")
    assert [tuple(r)[:2] for r in R.fold_scores(children, parents, {"cell": "a"}, 2, ties=()).collect()] == [(1, 0), (1, 1)]
    with pytest.raises(ValueError, match="no finished"):
        R.fold_scores(children, parents, {"cell": "b"}, 2, ties=())


def test_distinct_tokens_are_hashed_once(monkeypatch):
    words = ["", "a", "ab", "abc", "abcd", "Über", "中文字", "\x00\x7f", "x" * 1000, *(str(k) * (k % 9) for k in range(60)), *("y" * k for k in range(30))]
    want = [murmur3(w.encode()) for w in words]
    for many in (1, 16, 1000):
        monkeypatch.setattr(H, "MANY", many)
        assert H.hashes(pa.array(words)).tolist() == want and H.hashes(pa.array(["z", *words])[1:]).tolist() == want
    assert H.hashes(pa.array([], pa.string())).tolist() == []


def test_hashes_of_tokens_are_no_loop_over_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "a", None],), ([],), (None,), ([str(k) for k in range(40)],)], "t array<string>")
    got = df.select(H.hash_tokens("t", 16).alias("a"), F.expr(H.hashed("t", 16)).alias("b"))
    assert all(r["a"] == r["b"] and len(r["a"]) == 16 for r in got.collect())
    assert "lambda" not in df.select(H.hash_tokens("t", 16))._jdf.queryExecution().optimizedPlan().toString()


def test_kept_folds_have_partitions_by_rows(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i % 7), float(i % 5)]) for i in range(120)], "row_id long, y int, features array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        p = nested(rows, Pipeline(stages=[FeatureChain()]), [], 3)
        cores = spark.sparkContext.defaultParallelism
        assert p.rdd.getNumPartitions() <= 3 * cores
        assert sorted(r["row_id"] for r in p.collect()) == list(range(120))
        want = {r["row_id"]: r["fold"] for r in sampling.folds(rows, "y", "row_id", 3).collect()}
        assert {r["row_id"]: r["fold"] for r in p.collect()} == want
        assert sampling.gathered(rows, "row_id", 50 * sampling.SHARE).rdd.getNumPartitions() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
