"""Queries on the run store: sweeps (orders) and their folds (line items).

Stand-in: an order is a sweep, finished if its status is F, started on its date, of the cell named by its priority; a line
is a fold with l_discount as metric, l_linestatus as encoding, l_shipdate as start. A clean sweep is finished and has all folds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.functions.scalars import sweep_encoding
from foldspark.operators import runstore as R
from foldspark.plans.catalog import query, table

FOLDS = 5
CLEAN = f"""c AS (SELECT l_orderkey FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1 HAVING count(*) = {FOLDS}
      INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
TIES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
MASTER = f"""m AS (SELECT o_orderpriority AS cell, o_orderkey AS parent_run_id, min(o_orderdate) AS sweep_start,
       CAST(min(l_linenumber) AS INTEGER) AS n_components, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'joint' END AS encoding,
       round(avg(l_discount), 6) AS f1_macro_mean, round(stddev_pop(l_discount), 6) AS f1_macro_std,
       round(avg(CASE WHEN l_returnflag <> 'N' THEN l_tax END), 6) AS spread_mean, CAST(count(*) AS BIGINT) AS n_folds
  FROM lineitem JOIN c USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def parents(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED").alias("status"),
        F.col("o_orderdate").alias("start_time"), F.col("o_orderpriority").alias("cell"))


def children(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("parent_run_id"), F.col("l_shipdate").alias("start_time"), F.col("l_discount").alias("f1_macro"), "l_tax", "l_returnflag",
        F.col("l_linestatus").alias("encoding"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("run_export", """
SELECT 's' || o_orderkey AS run_id, CAST(NULL AS VARCHAR) AS parent_run_id, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
       o_orderdate AS start_time, CAST(NULL AS DOUBLE) AS "metrics_f1_macro", CAST(NULL AS VARCHAR) AS "params_encoding" FROM orders
UNION ALL SELECT 's' || l_orderkey || '-' || l_linenumber, 's' || l_orderkey, 'FINISHED', l_shipdate, l_discount, l_linestatus FROM lineitem""")
def run_export(spark, d):
    """Sweeps and folds as one flat table, maps of parameters and metrics spread to columns."""
    up = parents(spark, d).select(F.concat(F.lit("s"), F.col("run_id").cast("string")).alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"), "status", "start_time", F.create_map().cast("map<string,double>").alias("metrics"), F.create_map().cast("map<string,string>").alias("params"))
    down = children(spark, d).select(
        F.concat(F.lit("s"), F.col("parent_run_id").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.concat(F.lit("s"), F.col("parent_run_id").cast("string")).alias("parent_run_id"), F.lit("FINISHED").alias("status"), "start_time", F.create_map(F.lit("f1_macro"), "f1_macro").alias("metrics"), F.create_map(F.lit("encoding"), "encoding").alias("params"))
    return R.flat(up.unionByName(down), ["f1_macro"], ["encoding"])


@query("parent_status_join", """
SELECT coalesce(o_orderstatus, 'none') AS parent_status, CAST(count(*) AS BIGINT) AS n_folds, round(avg(l_discount), 6) AS f1
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def parent_status_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_discount").join(o, "l_orderkey", "left")
    return j.groupBy(F.coalesce("o_orderstatus", F.lit("none")).alias("parent_status")).agg(F.count("*").alias("n_folds"), F.round(F.avg("l_discount"), 6).alias("f1"))


def clean(spark, d):
    return R.clean_sweeps(children(spark, d), parents(spark, d), FOLDS)


@query("clean_sweeps", f"WITH {CLEAN} SELECT l_orderkey AS parent_run_id, CAST(count(*) AS BIGINT) AS n_folds FROM lineitem JOIN c USING (l_orderkey) GROUP BY 1")
def clean_sweeps(spark, d):
    folds = children(spark, d).join(clean(spark, d), "parent_run_id", "left_semi")
    return folds.groupBy("parent_run_id").agg(F.count("*").alias("n_folds"))


@query("orphan_folds", """
SELECT l_orderkey AS parent_run_id, CAST(count(*) AS BIGINT) AS n_folds FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def orphan_folds(spark, d):
    done = parents(spark, d).filter("status = 'FINISHED'").select(F.col("run_id").alias("parent_run_id"))
    return children(spark, d).join(done, "parent_run_id", "left_anti").groupBy("parent_run_id").agg(F.count("*").alias("n_folds"))


@query("fold_order", f"""
SELECT l_orderkey AS parent_run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INTEGER) AS fold_no, l_discount AS f1_macro FROM lineitem""")
def fold_order(spark, d):
    return R.fold_numbers(children(spark, d), TIES).select("parent_run_id", "fold_no", "f1_macro")


@query("fold_scores", f"""
WITH {CLEAN}, s AS (SELECT o_orderpriority AS cell, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders JOIN c ON o_orderkey = l_orderkey)
SELECT cell, o_orderkey AS parent_run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INTEGER) AS fold_no, l_discount AS f1_macro
FROM s JOIN lineitem ON l_orderkey = o_orderkey WHERE r = 1""")
def fold_scores(spark, d):
    """Fold metrics of the newest clean sweep of each cell."""
    p = parents(spark, d).join(clean(spark, d).withColumnRenamed("parent_run_id", "run_id"), "run_id", "left_semi")
    newest = R.newest(p, "cell").select("cell", F.col("run_id").alias("parent_run_id"))
    return R.fold_numbers(children(spark, d).join(newest, "parent_run_id"), TIES).select("cell", "parent_run_id", "fold_no", "f1_macro")


@query("cell_scores", f"""
WITH {CLEAN}, s AS (SELECT o_orderkey FROM orders JOIN c ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
SELECT l_orderkey AS parent_run_id, CAST(row_number() OVER (ORDER BY {ORDER}) - 1 AS INTEGER) AS fold_no, l_discount AS f1_macro FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM s)""")
def cell_scores(spark, d):
    """Fold metrics of one cell, in fold order; an error where no clean sweep matches."""
    return R.fold_scores(children(spark, d), parents(spark, d), {"cell": "1-URGENT"}, FOLDS, ties=TIES)


@query("tagged_encoding", """
SELECT o_orderkey AS run_id, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'tagged' END, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) ELSE 'joint' END) AS encoding
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def tagged_encoding(spark, d):
    """A sweep's encoding: its own tag first, else what its folds agree on."""
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent_run_id"), F.when(F.col("o_orderstatus") == "P", "tagged").alias("tag"))
    folds = children(spark, d).groupBy("parent_run_id").agg(F.collect_set("encoding").alias("e"))
    return own.join(folds, "parent_run_id").select(F.col("parent_run_id").alias("run_id"), R.encoding(F.col("tag"), F.col("e")).alias("encoding"))


@query("prefer_fold_count", """
WITH n AS (SELECT o_orderpriority AS cell, o_orderkey, count(*) AS n_folds FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT cell, o_orderkey AS parent_run_id, CAST(n_folds AS BIGINT) AS n_folds FROM n
WHERE n_folds IN (5, 6) AND n_folds = (SELECT max(m.n_folds) FROM n m WHERE m.cell = n.cell AND m.n_folds IN (5, 6))""")
def prefer_fold_count(spark, d):
    """Six-fold sweeps where a cell has any, else five-fold ones; never both."""
    n = children(spark, d).groupBy("parent_run_id").agg(F.count("*").alias("n_folds")).filter("n_folds in (5, 6)")
    n = n.join(parents(spark, d).filter("status = 'FINISHED'").select(F.col("run_id").alias("parent_run_id"), "cell"), "parent_run_id")
    most = n.groupBy("cell").agg(F.max("n_folds").alias("n_folds"))
    return n.join(most, ["cell", "n_folds"], "left_semi").select("cell", "parent_run_id", "n_folds")


def master(spark, d):
    """Clean sweeps with the aggregates of their folds: one join and one aggregate, which also counts the folds that have the metric."""
    p = parents(spark, d).filter("status = 'FINISHED'").select(F.col("run_id").alias("parent_run_id"), "cell", F.col("start_time").alias("sweep_start"))
    folds = children(spark, d).join(p, "parent_run_id").groupBy("cell", "parent_run_id", "sweep_start").agg(
        F.min("l_linenumber").cast("int").alias("n_components"), sweep_encoding(F.collect_set("encoding")).alias("encoding"),
        F.round(F.avg("f1_macro"), 6).alias("f1_macro_mean"), F.round(F.stddev_pop("f1_macro"), 6).alias("f1_macro_std"),
        F.round(F.avg(F.when(F.col("l_returnflag") != "N", F.col("l_tax"))), 6).alias("spread_mean"), F.count("*").alias("n_folds"), F.count("f1_macro").alias("scored"))
    return folds.filter(F.col("scored") == FOLDS).drop("scored")


@query("master_table", f"WITH {CLEAN}, {MASTER} SELECT * FROM m")
def master_table(spark, d):
    return master(spark, d)


@query("is_latest_flag", f"""
WITH {CLEAN}, {MASTER} SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sweep_start DESC, parent_run_id DESC) = 1 AS is_latest FROM m""")
def is_latest_flag(spark, d):
    """All clean sweeps, the newest of each cell marked."""
    m = master(spark, d)
    newest = R.newest(m.withColumnsRenamed({"parent_run_id": "run_id", "sweep_start": "start_time"}), "cell").select(F.col("run_id").alias("parent_run_id"), F.lit(True).alias("is_latest"))
    return m.join(newest, "parent_run_id", "left").withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


@query("latest_clean_sweep", f"""
WITH {CLEAN}, {MASTER} SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY sweep_start DESC, parent_run_id DESC) = 1""")
def latest_clean_sweep(spark, d):
    """The current trustworthy result of each cell: scan, one join, one aggregate a sweep, arg-max by cell."""
    newest = R.newest(master(spark, d).withColumnsRenamed({"parent_run_id": "run_id", "sweep_start": "start_time"}), "cell")
    return newest.withColumnsRenamed({"run_id": "parent_run_id", "start_time": "sweep_start"})


@query("best_of_means", """
WITH a AS (SELECT l_returnflag, l_linenumber, avg(l_discount) AS m, stddev_pop(l_discount) AS s FROM lineitem GROUP BY 1, 2)
SELECT CAST(l_linenumber AS INTEGER) AS n_components, round(max(m), 6) AS best, round(avg(m), 6) AS mean, round(max(m + s), 6) AS band FROM a GROUP BY 1""")
def best_of_means(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("m"), F.stddev_pop("l_discount").alias("s"))
    return a.groupBy(F.col("l_linenumber").cast("int").alias("n_components")).agg(
        F.round(F.max("m"), 6).alias("best"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.max(F.col("m") + F.col("s")), 6).alias("band"))


@query("encoding_delta", """
WITH k AS (SELECT unnest([1, 3, 6, 8]) AS nc), a AS (SELECT l_linenumber AS nc, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS f, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS o FROM lineitem GROUP BY 1)
SELECT CAST(k.nc AS INTEGER) AS n_components, round(f, 6) AS angle, round(o, 6) AS iqp, round(f - o, 6) AS delta, round(greatest(f, o), 6) AS best FROM k LEFT JOIN a ON a.nc = k.nc""")
def encoding_delta(spark, d):
    """Means by a fixed list of keys, null where a key has none."""
    keys = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in (1, 3, 6, 8)])).alias("n_components"))
    f, o = (F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount"))) for s in ("F", "O"))
    a = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n_components")).agg(f.alias("f"), o.alias("o"))
    return keys.join(a, "n_components", "left").select(
        F.col("n_components").cast("int"), F.round("f", 6).alias("angle"), F.round("o", 6).alias("iqp"), F.round(F.col("f") - F.col("o"), 6).alias("delta"), F.round(F.greatest("f", "o"), 6).alias("best"))


@query("paired_cells", f"""
WITH {CLEAN}, s AS (SELECT o_orderpriority AS cell, o_orderstatus AS framework, o_orderkey, o_orderdate, count(*) AS n_folds FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
z AS (SELECT * FROM s WHERE n_folds IN (5, 6) QUALIFY row_number() OVER (PARTITION BY cell, framework ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT a.cell, a.o_orderkey AS kernel_run, b.framework AS classical, b.o_orderkey AS classical_run, a.n_folds = b.n_folds AS paired
FROM z a JOIN z b ON a.cell = b.cell AND a.framework = 'F' AND b.framework <> 'F'""")
def paired_cells(spark, d):
    """The newest sweep of a framework against each other framework's in the same cell; unequal fold counts aren't paired."""
    n = children(spark, d).groupBy(F.col("parent_run_id").alias("run_id")).agg(F.count("*").alias("n_folds")).filter("n_folds in (5, 6)")
    s = parents(spark, d).join(n, "run_id").withColumn("framework", F.when(F.col("status") == "FINISHED", "F").when(F.col("status") == "RUNNING", "O").otherwise("P"))
    z = R.newest(s, "cell", "framework")
    a = z.filter("framework = 'F'").select("cell", F.col("run_id").alias("kernel_run"), F.col("n_folds").alias("a"))
    b = z.filter("framework <> 'F'").select("cell", F.col("framework").alias("classical"), F.col("run_id").alias("classical_run"), F.col("n_folds").alias("b"))
    return a.join(b, "cell").select("cell", "kernel_run", "classical", "classical_run", (F.col("a") == F.col("b")).alias("paired"))


@query("intersect_keys", f"WITH {CLEAN} SELECT l_orderkey AS run_id FROM c")
def intersect_keys(spark, d):
    sized = children(spark, d).groupBy(F.col("parent_run_id").alias("run_id")).count().filter(F.col("count") == FOLDS).select("run_id")
    return sized.intersect(parents(spark, d).filter("status = 'FINISHED'").select("run_id"))


@query("except_keys", "SELECT o_orderkey AS run_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_keys(spark, d):
    """Sweeps without any fold."""
    return parents(spark, d).select("run_id").subtract(children(spark, d).select("parent_run_id"))


@query("aligned_predictions", """
WITH a AS (SELECT d.doc_id, quality AS y, CAST(n_chars > 1500 AS INTEGER) AS p FROM documents d JOIN labels l USING (doc_id)),
b AS (SELECT d.doc_id, quality AS y, CAST(lang = 'en' AS INTEGER) AS p FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 7 <> 0)
SELECT a.doc_id, CAST(a.y AS INTEGER) AS y, a.p AS pred_a, b.p AS pred_b FROM a JOIN b USING (doc_id) WHERE a.y = b.y""")
def aligned_predictions(spark, d):
    """Two models' predictions on the rows that both scored, label by label."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    a = both.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("pred"))
    b = both.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("y"), (F.col("lang") == "en").cast("int").alias("pred"))
    return R.aligned(a, b).withColumnRenamed("row_id", "doc_id")
