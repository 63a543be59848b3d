"""Scans, sinks, exports and reports, and what operators do with null strata, large keys and missing parts."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import features as X
from foldspark.operators import geometry as G
from foldspark.operators import ordered
from foldspark.operators import runstore as R
from foldspark.operators import sampling as P
from foldspark.operators import stats as T
from foldspark.operators.vectorize import GENERAL, SIZES, VERSIONS, WIDTHS
from foldspark.plans.labels import encode
from foldspark.sources import reports, runlog, tables
from tests.plain_vectors import vector
from tests.test_stats import record

ROOT = Path(__file__).resolve().parent.parent
BIG = 1 << 60


def test_large_keys_and_null_strata_are_kept(spark):
    rows = [(BIG + 7 * i, [None, "a", "b"][i % 3]) for i in range(30)] + [(-5, "a"), (-BIG, None)]
    df = spark.createDataFrame(rows, "k long, s string")
    f = P.folds(df, "s", "k", 4).collect()
    assert {(r["k"], r["s"]) for r in f} == set(rows)
    for s in (None, "a", "b"):
        n = [sum(r["s"] == s and r["fold"] == k for r in f) for k in range(4)]
        assert max(n) - min(n) <= 1
    assert sorted(map(tuple, P.folds(df.repartition(7), "s", "k", 4).collect()), key=str) == sorted(map(tuple, f), key=str)
    assert P.subsample(df, "s", "k", 12).count() == 12 and P.subsample(df, "s", "k", 99).count() == 32
    assert P.holdout(df, "s", "k", 8).filter("held_out").count() == 8
    assert X.balanced_weights(df, "s").count() == 32
    assert {r["s"]: r["y"] for r in encode(df, "s").collect()} == {None: 0, "a": 1, "b": 2}
    auc = ordered.rank_auc(df.withColumn("p", (F.col("k") % 2).cast("int")), ["s"], "k", "p")
    assert auc.count() == 3


def test_no_family_is_an_error(spark):
    with pytest.raises(ValueError, match="100 rows"):
        P.balanced(spark.range(5).withColumn("g", F.lit("x")), "g", "id", 100, 3)


def test_csv_and_metrics(spark, tmp_path):
    (tmp_path / "a.csv").write_text("f,Class\n1.5,Malware\n2.5, benign \n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), "f double, Class string")
    assert [tuple(r) for r in df.collect()] == [(1.5, "Malware"), (2.5, " benign ")] and tables.features(df) == ["f"]
    n = tables.write_tables({"m": df, "none": df.limit(0)}, str(tmp_path / "out"))
    assert n == {"m": 2, "none": 0}
    assert len(list((tmp_path / "out" / "m").glob("*.csv"))) == 1


def test_parquet_scans(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "label int, avclass string").write.parquet(str(tmp_path / "t"))
    assert [r["avclass"] for r in tables.read_tagged(spark, str(tmp_path / "t")).orderBy("label").collect()] == ["x", ""]
    assert tables.read_parquet(spark, str(tmp_path / "t"), ["label"]).columns == ["label"]
    spark.range(2).write.parquet(str(tmp_path / "untagged"))
    assert {r["avclass"] for r in tables.read_tagged(spark, str(tmp_path / "untagged")).collect()} == {""}
    with pytest.raises(FileNotFoundError, match="prepare builds it"):
        tables.read_parquet(spark, str(tmp_path / "none"), built_by="prepare")


def test_database_projection(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.range(100).select("id", (F.col("id") % 3).alias("g"), F.lit("x").alias("t")).write.jdbc(url, "rows_", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    except Exception as e:
        if "ClassNotFoundException" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database here")
        raise
    df = tables.read_table(spark, url, "rows_", ["g", "id"], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4")
    assert df.columns == ["g", "id"] and df.rdd.getNumPartitions() == 4 and df.agg(F.sum("id")).first()[0] == 4950


def test_records_become_vectors(spark, tmp_path):
    numbers = lambda names: ", ".join(f"{n}: bigint" for n in names)
    schema = f"""sha256 string, label int, avclass string, histogram array<bigint>, byteentropy array<bigint>,
      strings struct<numstrings: bigint, avlength: double, printabledist: array<bigint>, printables: bigint, entropy: double, paths: bigint, urls: bigint, registry: bigint, MZ: bigint>,
      general struct<{numbers(GENERAL)}>, header struct<coff: struct<timestamp: bigint, machine: string, characteristics: array<string>>,
      optional: struct<subsystem: string, dll_characteristics: array<string>, magic: string, {numbers((*VERSIONS, *SIZES))}>>,
      section struct<entry: string, sections: array<struct<name: string, size: bigint, entropy: double, vsize: bigint, props: array<string>>>>,
      imports map<string, array<string>>, exports array<string>, datadirectories array<struct<name: string, size: bigint, virtual_address: bigint>>"""
    lines = [dict(record(), sha256=f"s{i}", label=y, avclass=a) for i, (y, a) in enumerate([(1, "fam"), (0, None), (-1, "gone")])]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert tables.vectors(spark, str(tmp_path / "r.jsonl"), schema, str(tmp_path / "v")) == 2
    got = {r["sha256"]: r for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    assert set(got) == {"s0", "s1"} and got["s1"]["avclass"] == ""
    assert len(got["s0"]["features"]) == sum(WIDTHS.values()) == 2381
    assert np.allclose(got["s0"]["features"], vector(record()))


def test_subset_of_a_wide_table(spark, tmp_path):
    wide = spark.range(50).select("id", *[(F.col("id") * i).alias(f"F{i}") for i in range(8)])
    n = tables.write_subset(wide, spark.createDataFrame([(3,), (7,), (7,), (99,)], "id long"), "id", str(tmp_path / "s"))
    assert n == {"rows": 50, "asked": 3, "written": 2} and spark.read.parquet(str(tmp_path / "s")).columns == wide.columns


def test_fold_and_sample_lists(spark, tmp_path):
    folds = spark.createDataFrame([(5, 0), (6, 1), (7, 0), (8, 1)], "row_id long, fold int")
    tables.write_fold_lists(folds, str(tmp_path / "f"))
    got = tables.read_folds(spark, str(tmp_path / "f"))
    assert {tuple(r) for r in got.collect()} == {(0, "train", 6), (0, "train", 8), (0, "test", 5), (0, "test", 7), (1, "train", 5), (1, "train", 7), (1, "test", 6), (1, "test", 8)}
    assert {tuple(r) for r in tables.read_fold_lists(spark, str(tmp_path / "f")).collect()} == {(0, 5), (0, 7), (1, 6), (1, 8)}
    (tmp_path / "bad.json").write_text('[{"train": [1, 2], "test": [2]}]')
    with pytest.raises(Exception, match="both lists"):
        tables.read_folds(spark, str(tmp_path / "bad.json")).collect()
    tables.write_keys(folds, str(tmp_path / "k"))
    tables.write_keys(folds.limit(2), str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 2
    tables.write_sample(spark.createDataFrame([(1, 9), (0, 4), (2, 5)], "sample_pos int, row_id long"), str(tmp_path / "s"))
    assert [r["row_id"] for r in tables.read_sample(spark, str(tmp_path / "s")).orderBy("sample_pos").collect()] == [4, 9, 5]


def test_predictions_are_read_by_folder(spark, tmp_path):
    rows = [("m", "t", 1, 0, 1), ("m", "t", 2, 1, 1), ("n", "t", 1, 1, 0)]
    tables.write_predictions(spark.createDataFrame(rows, "model string, task string, n_components int, y int, y_pred int"), str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p")).count() == 3
    one = tables.read_predictions(spark, str(tmp_path / "p"), "m", "t", 2)
    assert [(r["y"], r["y_pred"]) for r in one.collect()] == [(1, 1)]
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()


def test_runs_are_exported_flat(spark):
    rows = [("b", "a", "FINISHED", "2024-01-02", {"model": "svm"}, {"f1": 0.5}, {"user": "x"}), ("a", None, "FINISHED", "2024-01-01", {}, {}, {}), ("c", "a", "FAILED", "2024-01-03", {"model": "rf", "n": "1"}, {}, {})]
    runs = spark.createDataFrame(rows, "run_id string, parent_run_id string, status string, start_time string, params map<string,string>, metrics map<string,double>, tags map<string,string>")
    flat = runlog.export(runs)
    assert flat.columns == ["run_id", "parent_run_id", "status", "start_time", "params_model", "params_n", "metrics_f1"]
    assert [r["run_id"] for r in flat.collect()] == ["a", "b", "c"]
    assert [r["run_id"] for r in runlog.export(runs, "params_model = 'rf'").collect()] == ["c"]
    with pytest.raises(ValueError, match="no runs"):
        runlog.export(runs, "params_model = 'none'")


def test_scores_of_a_cell(spark):
    parents = spark.createDataFrame([("p1", "FINISHED", 1), ("p2", "FINISHED", 2), ("p3", "RUNNING", 3), ("p4", "FINISHED", 4)], "run_id string, status string, start_time int")
    kids = [(f"{p}-{i}", p, "FINISHED", 10 - i, "svm", 3, 0.1 * i + v) for p, v in (("p1", 0.0), ("p2", 0.5), ("p3", 0.7)) for i in range(2)] + [("p4-0", "p4", "FINISHED", 1, "svm", 3, 0.9)]
    children = spark.createDataFrame(kids, "run_id string, parent_run_id string, status string, start_time int, model string, n_components int, f1_macro double")
    got = R.fold_scores(children, parents, {"model": "svm", "n_components": 3}, 2).orderBy("fold_no").collect()
    assert [(r["parent_run_id"], round(r["f1_macro"], 3)) for r in got] == [("p2", 0.6), ("p2", 0.5)]  # by start
    with pytest.raises(ValueError, match="svm/4: no finished sweep"):
        R.fold_scores(children, parents, {"model": "svm", "n_components": 4}, 2)
    with pytest.raises(ValueError, match="parent_run_id"):
        R.fold_scores(children.drop("parent_run_id"), parents, {"model": "svm"}, 2)


def test_paired_tests_by_group(spark):
    rows = [("x", 0.1 * i, 0.1 * i + 0.05 + 0.001 * i) for i in range(5)] + [("y", 1.0, 1.0), ("y", 2.0, 2.0)] + [(None, 1.0, 2.0)]
    got = {r["g"]: r for r in T.paired_tests(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b").collect()}
    assert got["x"]["n"] == 5 and got["x"]["ttest_significant"] is True and got["x"]["wilcoxon_p"] == pytest.approx(0.0625)
    assert got["x"]["ttest_p"] == pytest.approx(T.ttest_p(got["x"]["t"], 5))
    assert got["y"]["ttest_p"] is None and got["y"]["ttest_significant"] is None and got["y"]["wilcoxon_p"] == 1.0
    assert got[None]["ttest_significant"] is None


def test_mcnemar_by_group(spark):
    rows = [("a", 1, 1, 0)] * 9 + [("a", 1, 0, 1)] + [("b", 1, 1, None)]
    got = {r["g"]: r for r in T.mcnemar(spark.createDataFrame(rows, "g string, y int, p int, q int"), ["g"], "y", "p", "q").collect()}
    assert (got["a"]["n01"], got["a"]["n10"]) == (1, 9) and got["a"]["pvalue"] == pytest.approx(T.mcnemar_p(1, 9)) and got["a"]["significant"] is True
    assert got["b"]["n"] == 0 and got["b"]["pvalue"] is None and got["b"]["significant"] is None


def test_rejected_distributions(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 4 == 0), float(rng.normal()), float(rng.normal() + 2 * (i % 4 == 0)), "c") for i in range(800)]
    r = G.representativeness(spark.createDataFrame(rows, "s int, same double, moved double, y string"), "y", ["same", "moved"], "s").first()
    assert (r["n_features"], r["n_reject"], float(r["expected_rejects"]), r["n_sample"]) == (2, 1, 0.1, 200) and r["max_abs_diff"] == 0


def test_chain_of_all_folds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, (300, 3))
    rows = [(int(i % 3), *map(float, v), float(2 * v[0]), 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, twice double, one double")
    chain = X.Chain(df, ["a", "b", "c", "twice", "one"], 3)
    assert all(f["kept"] == ["a", "b", "c"] and sum(f["explained"]) == pytest.approx(1) for f in chain.fits.values())
    z = np.array([r["z"] for r in chain.transform(df.filter("fold <> 0").withColumn("fold", F.lit(0))).collect()])  # the training rows of fold 0
    assert np.allclose(z.mean(0), 0, atol=1e-8) and np.allclose(np.cov(z.T, bias=True), np.diag(z.var(0)), atol=1e-8) and z.var(0).sum() == pytest.approx(3)
    with pytest.raises(ValueError, match="components"):
        X.Chain(df, ["a", "b"], 3)
    with pytest.raises(ValueError, match="several tables"):
        X.stitch([df.withColumn("id", F.lit(1)), df.withColumn("id", F.lit(1))], "id")


def test_reports(spark):
    of = lambda x: spark.createDataFrame([(json.dumps(x),)], "json string")
    test = {"statistic": 1.0, "pvalue": 0.01}
    c = {"dataset": "d", "task": "t", "n_components": 3, "quantum": "q", "classical": "c", "qsvm_mean": 0.1, "classical_mean": 0.3, "delta": 0.2, "ttest": test, "wilcoxon": {"statistic": 0.0, "pvalue": 0.0625}}
    r = reports.significance(of({"comparisons": [c, dict(c, ttest={"statistic": 0.1, "pvalue": 0.5})]})).collect()
    assert [x["ttest_significant_at_05"] for x in r] == [True, False] and r[0]["wilcoxon_pvalue"] == 0.0625
    r = reports.skipped(of({"skipped": ["d/t/nc=3/m/iqp: only: 4", "d/t/nc=12/m: none"]})).collect()
    assert [tuple(x) for x in r] == [("d", "t", 3, "m", "iqp", "only: 4"), ("d", "t", 12, "m", "", "none")]
    r = reports.mcnemar(of([{"group": "g", "pair": ["a", "b"], "shared_test_set": True, "n": 5, "n01": 1, "n10": 2, "statistic": 1.0, "pvalue": 0.9}, {"group": "g", "pair": ["a", "c"], "shared_test_set": False, "n": 0, "skipped": "no overlap"}])).collect()
    assert [x["significant_at_05"] for x in r] == [False, None] and r[1]["skipped"] == "no overlap" and r[0]["skipped"] == ""
    g = {"d": {"source": "s", "n_full_rows": 9, "n_subsample_rows": 3, "representativeness": {"n_reject": 1.0}, "geometry": {"3": {"fisher": {"mean": 1.0, "std": 0.5}}}}}
    assert [tuple(x) for x in reports.representativeness(of(g)).collect()] == [("d", "s", 9, 3, "n_reject", 1.0)]
    assert [tuple(x) for x in reports.geometry(of(g)).collect()] == [("d", 3, "fisher", 1.0, 0.5)]
    k = {"d": {"n_train_rows": 8, "n_qubits": 2, "quantum": {"offdiag_std": 0.1, "alignment": 0.5}, "rbf_control": {"offdiag_std": 0.2, "alignment": 0.4, "gamma": 0.7}}}
    r = {x["kernel"]: x for x in reports.kernels(of(k), of({"d": {"constant_kernel_alignment_baseline": 0.3}})).collect()}
    assert r["qsvm_fidelity"]["alignment_excess_over_baseline"] == pytest.approx(0.2) and r["qsvm_fidelity"]["rbf_gamma"] is None and r["rbf_control"]["rbf_gamma"] == 0.7


def test_the_rest_runs_without_the_document_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    path = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != ROOT]  # libraries may lie there too
    env = os.environ | {"PYTHONPATH": ":".join(path)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'latest_clean_sweep' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for extra in ((), ("corpus_pipeline.py",)):
        for f in extra:
            (copy / f).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stdout[-2000:]
