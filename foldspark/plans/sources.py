"""Queries that write a table in another form and read it back: what comes out equals the table."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import sampling
from foldspark.operators.labelstats import stats
from foldspark.operators.vectorize import GENERAL, RECORD_SCHEMA, vectorize
from foldspark.plans.catalog import ORACLE, query, table
from foldspark.plans.features import _murmur_sql
from foldspark.plans.profiles import TAGS, users
from foldspark.plans.samples import LCG
from foldspark.sources import committed, sqlite, tables, wide
from foldspark.sources.shared import shared_dir


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, d):
    """A table as CSV files with a header, read by an explicit schema."""
    path = folder(spark, "csv")
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    df.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, df.schema).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("tagged_scan", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') AS tag FROM documents")
def tagged_scan(spark, d):
    """A table whose tag column holds nulls."""
    path = folder(spark, "tagged")
    table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("tag")).write.parquet(path)
    return tables.read_tagged(spark, path, "tag")


def _databases(df: DataFrame, path: str) -> DataFrame:
    """A SQLite file for each task, with a table t of its rows; (path) of each."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        file = f"{path}/{uuid.uuid4().hex}.db"
        with closing(sqlite3.connect(file)) as db:
            db.execute(f"CREATE TABLE t ({', '.join(f'{n} INTEGER' for n in names)})")
            for b in batches:
                db.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in b.columns), strict=True))
            db.commit()
        yield pa.record_batch({"path": [file]})

    return df.mapInArrow(run, "path string")


@query("sqlite_label_stats", ORACLE["label_stats"])
def sqlite_label_stats(spark, d):
    """Label statistics of a table in SQLite files, read in ranges of row ids."""
    counts = users(spark, d).select("user_id", *[F.col(t).cast("long").alias(t) for t in TAGS]).repartition(2)
    path = folder(spark, "sqlite").removeprefix("file://").removeprefix("file:")
    files = [r["path"] for r in _databases(counts, path).collect()]  # a name for each of two tasks
    parts = [sqlite.read(spark, f, "t", ", ".join(f"{t} bigint" for t in TAGS)) for f in files]
    return stats(parts[0].union(parts[1]), list(TAGS))


@query("record_vectors", f"""
WITH r AS (SELECT o_orderkey, [o_orderpriority, o_orderstatus] AS e, o_custkey % 1000 AS size, (o_orderstatus = 'F')::INT AS exports FROM orders), t AS (SELECT o_orderkey, unnest(e) AS w FROM r), u AS (SELECT DISTINCT w FROM t), {_murmur_sql()},
s AS (SELECT o_orderkey, 10 + abs(h) % 128 AS i, sum(sign(h + 0.5))::DOUBLE AS v FROM t JOIN h USING (w) GROUP BY ALL)
SELECT o_orderkey, i::INT AS i, v FROM s WHERE v <> 0 UNION ALL SELECT o_orderkey, 0::INT, size::DOUBLE FROM r WHERE size <> 0 UNION ALL SELECT o_orderkey, 3::INT, 1.0::DOUBLE FROM r WHERE exports = 1""")
def record_vectors(spark, d):
    """Nested records as JSON lines, read by their schema, and the vectors of two blocks, without zeros."""
    path = folder(spark, "records")
    o = table(spark, d, "orders")
    general = F.struct(*[(F.col("o_custkey") % 1000 if c == "size" else (F.col("o_orderstatus") == "F").cast("long") if c == "exports" else F.lit(0)).alias(c) for c in GENERAL])
    record = F.struct(F.col("o_orderkey").cast("string").alias("sha256"), F.lit(1).alias("label"), general.alias("general"), F.array("o_orderpriority", "o_orderstatus").alias("exports"))
    o.select(F.to_json(record).alias("value")).write.text(path)
    v = vectorize(tables.read_records(spark, path, RECORD_SCHEMA), ("general", "exports"))
    return v.select(F.col("sha256").cast("long").alias("o_orderkey"), F.posexplode("features").alias("i", "v")).filter("v <> 0").withColumn("v", F.col("v").cast("double"))


_FOLDS = f"f AS (SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {LCG.format(k='o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold, o_orderpriority FROM orders)"


def _folds(spark, d) -> DataFrame:
    return sampling.folds(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5)


@query("fold_lists", f"WITH {_FOLDS} SELECT k::INT AS fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM f, (SELECT unnest(range(5)) AS k) GROUP BY ALL")
def fold_lists(spark, d):
    """Folds as JSON lists of training and test rows, read back."""
    path = folder(spark, "folds")
    tables.write_fold_lines(_folds(spark, d).select(F.col("o_orderkey").alias("row_id"), "fold"), path)
    return tables.read_folds(spark, path, lines=True).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("inner_folds", f"""
WITH {_FOLDS}, k AS (SELECT unnest(range(5))::INT AS outer_fold),
i AS (SELECT outer_fold, o_orderkey, CAST((row_number() OVER (PARTITION BY outer_fold, o_orderpriority ORDER BY {LCG.format(k='o_orderkey').replace('42', '43')}, o_orderkey) - 1) % 3 AS INTEGER) AS inner_fold FROM f, k WHERE fold <> outer_fold)
SELECT outer_fold, inner_fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM i GROUP BY ALL""")
def inner_folds(spark, d):
    """Stratified folds among the training rows of each fold: gathered, split and put together again."""
    rows = _folds(spark, d).persist()
    out = None
    for k in range(5):
        train = sampling.folds(rows.filter(F.col("fold") != k).drop("fold"), "o_orderpriority", "o_orderkey", 3, 43).withColumn("outer_fold", F.lit(k))
        out = train if out is None else out.unionByName(train)
    return out.groupBy("outer_fold", F.col("fold").alias("inner_fold")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("sample_list", f"SELECT CAST(row_number() OVER (ORDER BY {LCG.format(k='vec_id')}, vec_id) - 1 AS INTEGER) AS sample_pos, vec_id AS row_id FROM embeddings")
def sample_list(spark, d):
    """A sample as a JSON list whose order counts, read back."""
    path = folder(spark, "sample")
    ranked = sampling.stratum_rank(table(spark, d, "embeddings").select("vec_id", F.lit(0).alias("s")), ["s"], "vec_id")
    tables.write_sample(ranked.select((F.col("rank") - 1).alias("sample_pos"), F.col("vec_id").alias("row_id")), path)
    return tables.read_sample(spark, path)


@query("predictions_by_folder", "SELECT l_returnflag AS model, 'F' AS task, 3 AS n_components, l_linestatus AS y_pred, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL")
def predictions_by_folder(spark, d):
    """Predictions in folders of model, task and components: one model's are read, and writing it again replaces no other's."""
    path = folder(spark, "predictions")
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.lit("F").alias("task"), F.lit(3).alias("n_components"), "l_orderkey", F.col("l_linestatus").alias("y_pred"))
    tables.write_predictions(p, path)
    tables.write_predictions(p.filter("model = 'R'"), path)
    return tables.read_predictions(spark, path, model="A").groupBy("model", "task", "n_components", "y_pred").agg(F.count("*").alias("n"))


@query("metrics_files", "SELECT 'by_flag' AS name, l_returnflag AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'by_status', l_linestatus, CAST(count(*) AS BIGINT) FROM lineitem GROUP BY ALL")
def metrics_files(spark, d):
    """Derived tables as a CSV file each, read back."""
    path, rows = folder(spark, "metrics"), table(spark, d, "lineitem")
    made = {name: rows.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")) for name, c in (("by_flag", "l_returnflag"), ("by_status", "l_linestatus"))}
    tables.write_tables(made, path)
    parts = [tables.read_csv(spark, f"{path}/{name}", "k string, n long").select(F.lit(name).alias("name"), "k", "n") for name in made]
    return parts[0].union(parts[1])


@query("numeric_columns", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name <> 'l_orderkey'")
def numeric_columns(spark, d):
    """Features are the numeric columns that aren't labels; a label that has to be there is dropped with a check."""
    df = tables.without(table(spark, d, "lineitem"), "l_orderkey")
    return spark.createDataFrame([(c,) for c in tables.features(df, ("l_returnflag",))], "name string")


@query("run_store", """
SELECT l_returnflag AS model, CAST(l_linenumber AS INTEGER) AS fold, round(avg(l_discount), 6) AS f1, 'FINISHED' AS status, TRUE AS has_parent FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_returnflag, NULL, round(avg(m), 6), 'FINISHED', FALSE FROM (SELECT l_returnflag, l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT 'broken', NULL, NULL, 'FAILED', FALSE""")
def run_store(spark, d):
    """Sweeps committed to the store of runs, one commit each, beside a run that failed: the last state of every run."""
    path = folder(spark, "runs")
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg(F.create_map(F.lit("f1"), F.avg("l_discount")).alias("metrics")).persist()
    for r in m.select("model").distinct().collect():  # models, a commit each
        committed.log_sweep(m.filter(F.col("model") == r["model"]).select("fold", "metrics"), path, {"model": r["model"]})
    try:
        with committed.Run(spark, path, {"model": "broken"}):
            raise InterruptedError("on purpose")
    except InterruptedError:
        m.unpersist()
    runs = committed.current(committed.read(spark, path))
    return runs.select(F.col("params")["model"].alias("model"), F.col("params")["fold"].cast("int").alias("fold"), F.round(F.col("metrics")["f1"], 6).alias("f1"), "status", F.col("parent_run_id").isNotNull().alias("has_parent"))


@query("late_gather", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice, l_returnflag, l_shipdate FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def late_gather(spark, d):
    """The rows of some keys, wide columns read only from row groups that hold them."""
    keys = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = wide.gather(spark, f"{d}/lineitem.parquet", keys, "l_orderkey", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"])
    return rows.withColumn("l_extendedprice", F.round("l_extendedprice", 6))
