"""Queries on labels, projections, predicates and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspark.functions import scalars as S
from foldspark.operators.joins import join_nulls
from foldspark.plans.catalog import query, table
from foldspark.sources import reports

NOT_FEATURES = ("l_returnflag", "l_linestatus", "l_shipdate")


@query("scan_project_prune", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem WHERE l_quantity >= 45""")
def scan_project_prune(spark, d):
    """Features are all columns but the labels; the filter and the pruned schema reach the scan."""
    df = table(spark, d, "lineitem")
    return df.filter("l_quantity >= 45").drop(*NOT_FEATURES)


@query("json_flatten", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def json_flatten(spark, d):
    """Nested JSON entries as rows, counted."""
    e = table(spark, d, "events").withColumn("entry", F.explode(F.map_entries(F.from_json("props", "map<string,bigint>"))))
    e = e.filter("entry.key = 'k'")
    return e.groupBy("event_type", F.col("entry.value").alias("k")).agg(F.count("*").alias("n"))


@query("binary_label", """
SELECT c_custkey, CAST(lower(trim(c_mktsegment)) = 'building' AS INTEGER) AS y FROM customer""")
def binary_label(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.binary_label(F.col("c_mktsegment"), "building").alias("y"))


@query("family_prefix", """
SELECT o_orderkey, trim(array_to_string(string_split(o_orderpriority, '-')[1:2], '-')) AS family FROM orders""")
def family_prefix(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.prefix(F.col("o_orderpriority"), 2).alias("family"))


@query("category_prefix", """
SELECT split_part(o_orderpriority, '-', 1) AS category, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def category_prefix(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.split("o_orderpriority", "-")[0].alias("category")).agg(F.count("*").alias("n"))


def encode(df, label: str, name: str = "y"):
    """df with a dense code of `label` in lexicographic order. Codes are ranked on the distinct labels, not on the rows; null comes first."""
    codes = df.select(label).distinct()
    codes = codes.withColumn(name, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return join_nulls(df, codes, [label])


@query("label_encode", """
SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS y FROM orders""")
def label_encode(spark, d):
    return encode(table(spark, d, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority", "y")


@query("filter_reencode", """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS y
FROM events WHERE event_type <> 'view'""")
def filter_reencode(spark, d):
    """Rows of the kept classes, with contiguous codes."""
    return encode(table(spark, d, "events").filter("event_type <> 'view'"), "event_type").select("event_id", "event_type", "y")


@query("predicate_compound", """
SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality = 1 AND d.lang IS NOT NULL AND d.lang <> ''""")
def predicate_compound(spark, d):
    docs = table(spark, d, "documents").filter("lang is not null and lang <> ''").select("doc_id", "lang")
    return docs.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("null_coalesce", """
SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS INTEGER) AS label, coalesce(d.lang, '') AS family
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 0) <> -1""")
def null_coalesce(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    out = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").filter("coalesce(quality, 0) <> -1")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("label"), F.coalesce("lang", F.lit("")).alias("family"))


@query("case_series", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'R-' || coalesce(l_linestatus, '') ELSE l_returnflag END AS series,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_linenumber IN (1, 3, 6) GROUP BY 1""")
def case_series(spark, d):
    df = table(spark, d, "lineitem").filter(F.col("l_linenumber").isin(1, 3, 6))
    return df.groupBy(S.series(F.col("l_returnflag"), F.col("l_linestatus"), "R").alias("series")).agg(F.count("*").alias("n"))


@query("cost_per_eval", """
SELECT l_shipdate, l_linenumber,
       round(CASE WHEN sum(l_quantity) > 0 THEN 1000000 * sum(l_tax) / sum(l_quantity) END, 6) AS us_per_eval
FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = '1998-07' GROUP BY l_shipdate, l_linenumber""")
def cost_per_eval(spark, d):
    """Cost for each evaluation in one month. A range of dates, unlike a text prefix, can be pushed down."""
    df = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1998-07-01' and l_shipdate < timestamp_ntz'1998-08-01'")
    q = F.sum("l_quantity")
    cost = F.when(q > 0, F.try_divide(F.sum("l_tax") * 1_000_000, q))
    return df.groupBy("l_shipdate", "l_linenumber").agg(F.round(cost, 6).alias("us_per_eval"))


@query("parse_cell_key", """
WITH k AS (SELECT p_partkey, p_brand || '/' || p_type || '/nc=' || p_size || CASE WHEN p_size % 2 = 0 THEN '/iqp' ELSE '' END
                  || ': only ' || p_size || ': folds' AS cell FROM part),
s AS (SELECT p_partkey, cell, strpos(cell, ': ') AS pos FROM k)
SELECT p_partkey, split_part(left(cell, pos - 1), '/', 1) AS dataset, split_part(left(cell, pos - 1), '/', 2) AS task,
       CAST(replace(split_part(left(cell, pos - 1), '/', 3), 'nc=', '') AS INTEGER) AS n_components,
       split_part(left(cell, pos - 1), '/', 4) AS encoding, substr(cell, pos + 2) AS reason FROM s""")
def parse_cell_key(spark, d):
    """Keys like dataset/task/nc=3[/encoding]: reason, taken apart; the reason may hold the separator again."""
    tail = F.when(F.col("p_size") % 2 == 0, F.lit("/iqp")).otherwise(F.lit(""))
    cell = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/nc="), F.col("p_size").cast("string"), tail, F.lit(": only "), F.col("p_size").cast("string"), F.lit(": folds"))
    k = table(spark, d, "part").select("p_partkey", F.split(cell, ": ", 2).alias("c")).withColumn("f", F.split(F.col("c")[0], "/"))
    return k.select(
        "p_partkey", F.col("f")[0].alias("dataset"), F.col("f")[1].alias("task"),
        F.regexp_extract(F.col("f")[2], r"^nc=(\d+)$", 1).cast("int").alias("n_components"),
        F.coalesce(F.try_element_at("f", F.lit(4)), F.lit("")).alias("encoding"), F.col("c")[1].alias("reason"))


@query("null_profile", """
SELECT CAST(count(*) - count(d.lang) AS BIGINT) AS lang, CAST(count(*) - count(l.quality) AS BIGINT) AS quality,
       CAST(count(*) - count(l.toxic) AS BIGINT) AS toxic,
       CAST(3 * count(*) - count(d.lang) - count(l.quality) - count(l.toxic) AS BIGINT) AS missing_cells
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def null_profile(spark, d):
    df = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    missing = {c: F.count_if(F.col(c).isNull()) for c in ("lang", "quality", "toxic")}
    total = missing["lang"] + missing["quality"] + missing["toxic"]
    return df.agg(*[m.alias(c) for c, m in missing.items()], total.alias("missing_cells"))


@query("softmax_rows", """
WITH e AS (SELECT vec_id, [exp(x::DOUBLE - list_max(embedding)) FOR x IN embedding] AS p FROM embeddings)
SELECT vec_id, CAST(unnest(range(len(p))) AS INTEGER) AS k, round(unnest(p) / list_sum(p), 6) AS p FROM e""")
def softmax_rows(spark, d):
    """A softmax over all components of each row."""
    e = table(spark, d, "embeddings").select("vec_id", S.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    return e.select("vec_id", F.posexplode("p").alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@query("sweep_encoding", """
SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) WHEN count(DISTINCT l_linestatus) > 1 THEN 'joint' END AS encoding
FROM lineitem GROUP BY l_orderkey""")
def sweep_encoding(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("s"))
    return df.select("l_orderkey", S.sweep_encoding(F.col("s")).alias("encoding"))


@query("sizing_solver", """
SELECT p_partkey, CAST(floor(400 * pow(p_size / 11.4::DOUBLE, 0.5) + 1e-9) AS INTEGER) AS n FROM part WHERE p_size > 0""")
def sizing_solver(spark, d):
    return table(spark, d, "part").filter("p_size > 0").select("p_partkey", S.sample_size(F.col("p_size"), 400, 11.4, 2.0).alias("n"))


@query("qubit_budget", """
SELECT DISTINCT p_size, CAST(greatest(1, ceil(log2(greatest(p_size, 1)))) AS INTEGER) AS amplitude_qubits, CAST(p_size AS INTEGER) AS angle_qubits,
       round(pow(p_size, -0.5), 6) AS bandwidth FROM part WHERE p_size > 0""")
def qubit_budget(spark, d):
    df = table(spark, d, "part").filter("p_size > 0").select("p_size").distinct()
    n = F.col("p_size")
    return df.select("p_size", S.n_qubits(n, "amplitude").alias("amplitude_qubits"), S.n_qubits(n, "angle").alias("angle_qubits"), F.round(F.pow(n.cast("double"), F.lit(-0.5)), 6).alias("bandwidth"))


@query("gate_counts", """
SELECT DISTINCT p_size, CAST(2 * (3 * p_size - 1) AS BIGINT) AS angle_gates, CAST(4 * p_size + p_size * (p_size - 1) AS BIGINT) AS iqp_gates
FROM part WHERE p_size > 0""")
def gate_counts(spark, d):
    df = table(spark, d, "part").filter("p_size > 0").select("p_size").distinct()
    return df.select("p_size", S.gates(F.col("p_size"), "angle").alias("angle_gates"), S.gates(F.col("p_size"), "iqp").alias("iqp_gates"))


@query("report_geometry", """
SELECT l_linestatus AS dataset, CAST(l_linenumber AS INTEGER) AS n_components, unnest(['discount', 'tax']) AS name, round(unnest([avg(l_discount), avg(l_tax)]), 6) AS mean, round(unnest([stddev_pop(l_discount), stddev_pop(l_tax)]), 6) AS std
FROM lineitem GROUP BY 1, 2""")
def report_geometry(spark, d):
    """A nested report (dataset, number of components, measure) written as JSON and read back as rows."""
    measure = lambda c: F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").cast("string").alias("nc")).agg(F.create_map(F.lit("discount"), measure("l_discount"), F.lit("tax"), measure("l_tax")).alias("m"))
    g = g.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("nc", "m"))).alias("geometry"))
    whole = g.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", F.struct("geometry"))))).alias("json"))
    return reports.geometry(whole).select("dataset", "n_components", "name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("report_pairs", """
SELECT l_returnflag AS "group", 'F' AS model_a, 'O' AS model_b, TRUE AS shared_test_set, CAST(count(*) AS BIGINT) AS n_samples, CAST(CASE WHEN l_returnflag <> 'N' THEN count(*) FILTER (l_discount < 0.05) END AS BIGINT) AS n01_a_wrong_b_right,
  CASE WHEN l_returnflag <> 'N' THEN round(avg(l_discount), 6) END AS pvalue, CASE WHEN l_returnflag <> 'N' THEN round(avg(l_discount), 6) < 0.05 END AS significant_at_05, CASE WHEN l_returnflag = 'N' THEN 'no overlap' ELSE '' END AS skipped
FROM lineitem GROUP BY l_returnflag""")
def report_pairs(spark, d):
    """A list of pairs, some of them skipped, written as JSON and read back: what a skipped pair lacks stays null."""
    n = F.col("l_returnflag") == "N"
    low = F.count_if(F.col("l_discount") < 0.05)
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), low.alias("n01"), F.round(F.avg("l_discount"), 6).alias("p"))
    one = F.struct(
        F.col("l_returnflag").alias("group"), F.array(F.lit("F"), F.lit("O")).alias("pair"), F.lit(True).alias("shared_test_set"), "n", F.when(~n, F.col("n01")).alias("n01"),
        F.when(~n, F.col("p")).alias("pvalue"), F.when(n, F.lit("no overlap")).alias("skipped"))
    r = reports.mcnemar(g.agg(F.to_json(F.collect_list(one)).alias("json")))
    return r.select("group", "model_a", "model_b", "shared_test_set", "n_samples", "n01_a_wrong_b_right", "pvalue", "significant_at_05", "skipped")
