"""The run store's commits and run states, and SQLite tables read in ranges."""

import os
import sqlite3
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foldspark.operators import labelstats
from foldspark.sources import committed as C
from foldspark.sources import sqlite as S


def states(spark, rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, None, s, at, datetime(2024, 1, 1, 0, m), {"a": "1"}, {"f": float(m)}, {}) for i, s, m in rows], C.SCHEMA)


def test_appends_are_read_once_committed(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert C.read(spark, path).count() == 0
    C.append(states(spark, [("a", C.RUNNING, 1), ("b", C.RUNNING, 1)]).repartition(2), path)
    C.append(states(spark, [("a", C.FINISHED, 2), ("b", C.FAILED, 3)]), path)
    C.append(states(spark, []), path)
    assert C.read(spark, path).count() == 4
    assert {(r["run_id"], r["status"], r["metrics"]["f"]) for r in C.current(C.read(spark, path)).collect()} == {("a", C.FINISHED, 2.0), ("b", C.FAILED, 3.0)}
    with pytest.raises(Exception, match="appended"):
        states(spark, [("a", C.RUNNING, 1)]).write.format("runs").mode("overwrite").save(path)
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("runs").mode("append").save(path)


def test_killed_writers_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    C.append(states(spark, [("a", C.FINISHED, 1)]), path)
    broken = F.udf(lambda i: 1 / 0 if i == "x7" else i)
    many = states(spark, [(f"x{i}", C.FINISHED, 1) for i in range(8)]).repartition(4)
    with pytest.raises(Exception, match="division"):
        C.append(many.withColumn("run_id", broken("run_id")), path)
    assert [r["run_id"] for r in C.read(spark, path).collect()] == ["a"]
    # a driver that is lost between the tasks' writes and its commit
    writer = C.RunWriter(path, many.schema)
    said = writer.write(iter(many.toArrow().to_batches()))
    assert said.rows == 8 and C.read(spark, path).count() == 1
    writer.abort([said, None])
    assert not os.path.exists(f"{path}/files/{said.names[0]}")
    # a commit that is half written has another name
    open(f"{path}/commits/_half", "w").write('{"files": ["nothing')
    assert C.read(spark, path).count() == 1


def test_appends_at_once_both_appear(spark, tmp_path):
    path = str(tmp_path / "runs")
    threads = [threading.Thread(target=lambda k=k: C.append(states(spark, [(f"{k}-{i}", C.FINISHED, 1) for i in range(5)]), path)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert C.read(spark, path).select("run_id").distinct().count() == 20


def test_lives_of_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    with C.Run(spark, path, {"model": "m", "n": 3}, {"sweep": "s"}) as parent:
        with C.Run(spark, path, parent=parent) as child:
            assert {r["status"] for r in C.current(C.read(spark, path)).collect()} == {C.RUNNING}
            child.log({"f1": 0.25})
        with pytest.raises(ZeroDivisionError), C.Run(spark, path, parent=parent) as bad:
            bad.log({"f1": 1 / 0})
    now = {r["run_id"]: r for r in C.current(C.read(spark, path)).collect()}
    assert now[parent.run_id]["status"] == C.FINISHED and now[parent.run_id]["params"] == {"model": "m", "n": "3"} and now[parent.run_id]["parent_run_id"] is None
    assert now[child.run_id]["status"] == C.FINISHED and now[child.run_id]["metrics"] == {"f1": 0.25} and now[child.run_id]["parent_run_id"] == parent.run_id
    assert now[bad.run_id]["status"] == C.FAILED and "ZeroDivisionError" in now[bad.run_id]["tags"]["error"]
    folds = spark.createDataFrame([(k, {"f1": k / 10, "accuracy": 1.0}) for k in range(3)], "fold int, metrics map<string,double>")
    sweep = C.log_sweep(folds, path, {"model": "x"})
    got = {r["run_id"]: r for r in C.current(C.read(spark, path)).collect() if sweep in (r["run_id"], r["parent_run_id"])}
    assert len(got) == 4 and got[sweep]["metrics"]["f1"] == pytest.approx(0.1) and got[f"{sweep}-2"]["params"]["fold"] == "2"


TAGS = ["adware", "worm", "spyware"]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "meta.db")
    rows = [(f"k{i}", i % 2, i % 3, (i * 7) % 4, 5 if i % 11 == 0 else 0, i / 8, None if i % 5 else "x'y\"") for i in range(45_000)]
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE meta (sha256 TEXT, is_malware INTEGER, {', '.join(f'{t} INT' for t in TAGS)}, score REAL, note VARCHAR(9))")
        db.executemany("INSERT INTO meta VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
        db.execute("DELETE FROM meta WHERE rowid BETWEEN 100 AND 12000")
        db.execute('CREATE TABLE "odd name" (k TEXT PRIMARY KEY, "a b" BOOLEAN) WITHOUT ROWID')
        db.executemany('INSERT INTO "odd name" VALUES (?, ?)', [("p", 1), ("q", 0), ("r", None)])
        db.execute("CREATE TABLE none (a INT)")
    return path, [r for i, r in enumerate(rows) if not 99 <= i < 12000]


def test_ranges_add_up_to_the_table(spark, database, tmp_path):
    path, rows = database
    df = S.read(spark, path, "meta")
    assert df.dtypes == [("sha256", "string"), ("is_malware", "bigint"), *[(t, "bigint") for t in TAGS], ("score", "double"), ("note", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    assert df.rdd.getNumPartitions() == 5
    df.write.parquet(str(tmp_path / "copy"))
    assert labelstats.stats(df, TAGS).collect() == labelstats.stats(spark.read.parquet(str(tmp_path / "copy")), TAGS).collect()


def test_columns_and_filters_go_to_the_database(spark, database):
    path, rows = database
    reader = S.FilteringReader(path, "meta", S.StructType([]), 2)
    left = list(reader.pushFilters([S.EqualTo(("is_malware",), 1), S.Not(S.In(("worm",), [2, 3])), S.IsNotNull(("note",)), S.EqualTo(("a", "b"), 1)]))
    assert left == [S.EqualTo(("a", "b"), 1)]
    assert reader.query(S.Rows(5, 9)) == ('SELECT 1 FROM "meta" WHERE rowid BETWEEN ? AND ? AND "is_malware" = ? AND NOT ("worm" IN (?, ?)) AND "note" IS NOT NULL', [5, 9, 1, 2, 3])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = S.read(spark, path, "meta", "sha256 string, worm bigint, note string").filter("worm > 1 AND note IS NULL AND sha256 IN ('k1', 'k12001', 'k12002')")
        want = sorted((r[0], r[3], r[6]) for r in rows if r[3] > 1 and r[6] is None and r[0] in ("k1", "k12001", "k12002"))
        assert sorted(map(tuple, df.collect())) == want and want
        assert df.columns == ["sha256", "worm", "note"]
        plan = lambda: S.read(spark, path, "meta").filter("worm > 1")._jdf.queryExecution().executedPlan().toString()
        assert "Filter " not in plan()  # the database has done it
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        assert "Filter " in plan()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_tables(spark, database):
    path, _ = database
    assert sorted(map(tuple, S.read(spark, path, "odd name").collect())) == [("p", True), ("q", False), ("r", None)]
    assert S.read(spark, path, "none").collect() == []
    with pytest.raises(Exception, match="no table"):
        S.read(spark, path, "missing")
