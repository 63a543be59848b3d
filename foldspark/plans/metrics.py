"""Queries on classification metrics and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.operators import metrics as M
from foldspark.operators import stats as T
from foldspark.operators.ordered import rank_auc
from foldspark.plans.catalog import query, table

DOCS = "x AS (SELECT quality AS y, CAST(n_chars > 1500 AS INTEGER) AS p, CAST(lang = 'en' AS INTEGER) AS q, n_chars AS s FROM documents JOIN labels USING (doc_id))"
VECS = "x AS (SELECT vec_id, label AS y, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS p FROM embeddings)"
KLASS = """k AS (SELECT l AS label, count(*) FILTER (y = l AND p = l)::DOUBLE AS tp, count(*) FILTER (p = l)::DOUBLE AS predicted, count(*) FILTER (y = l)::DOUBLE AS support
  FROM (SELECT y AS l FROM x UNION SELECT p FROM x), x GROUP BY 1),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM k)"""


def docs(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.select(F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), (F.col("lang") == "en").cast("int").alias("q"), F.col("n_chars").alias("s"))


def vecs(spark, d):
    first = F.slice("embedding", 1, 10)
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("p"))


@query("classification_metrics", f"""
WITH {DOCS}, {KLASS} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM m""")
def classification_metrics(spark, d):
    s = M.summary(M.confusion(docs(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("per_class_prf", f"""
WITH {DOCS}, {KLASS} SELECT CAST(label AS INTEGER) AS label, CAST(support AS BIGINT) AS support, round(precision, 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m""")
def per_class_prf(spark, d):
    k = M.per_class(M.confusion(docs(spark, d)))
    return k.select(F.col("label").cast("int"), F.col("support").cast("long"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("per_class_f1_fixed_labels", f"""
WITH {VECS}, {KLASS}, l AS (SELECT unnest(range(12)) AS label) SELECT CAST(l.label AS INTEGER) AS label, round(coalesce(f1, 0), 6) AS f1 FROM l LEFT JOIN m ON m.label = l.label""")
def per_class_f1_fixed_labels(spark, d):
    """A fixed list of labels; those that never occur keep a row with 0."""
    labels = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return M.per_class(M.confusion(vecs(spark, d)), labels).select(F.col("label").cast("int"), F.round("f1", 6).alias("f1"))


@query("mcc", f"""
WITH {VECS}, {KLASS} SELECT round(coalesce((sum(tp) * sum(support) - sum(predicted * support)) / nullif(sqrt((sum(support) ** 2 - sum(predicted ** 2)) * (sum(support) ** 2 - sum(support ** 2))), 0), 0), 6) AS mcc
FROM (SELECT tp, predicted, support FROM m)""")
def mcc(spark, d):
    return M.matthews(M.confusion(vecs(spark, d))).select(F.round("mcc", 6).alias("mcc"))


@query("confusion_matrix", f"WITH {VECS} SELECT CAST(y AS INTEGER) AS y, p, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return M.confusion(vecs(spark, d)).select(F.col("y").cast("int"), "p", "n")


@query("rank_auc", f"""
WITH {DOCS}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def auc(spark, d):
    return rank_auc(docs(spark, d), [], "s", "y").select(F.round("auc", 6).alias("auc"))


@query("ovr_auc", """
WITH e AS (SELECT label, unnest(range(10)) AS k, unnest([exp(x - list_max(embedding[1:10])) FOR x IN embedding[1:10]]) AS s FROM embeddings),
r AS (SELECT k, CAST(label = k AS INTEGER) AS y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM e),
a AS (SELECT k, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY 1)
SELECT round(avg(auc), 4) AS auc_macro, CAST(count(auc) AS BIGINT) AS n_classes FROM a""")
def ovr_auc(spark, d):
    """Each class against the rest on its own softmax score, then the plain mean."""
    e = table(spark, d, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x - F.array_max(F.slice("embedding", 1, 10)))).alias("s"))
    long = e.select("label", F.posexplode("s").alias("k", "s")).withColumn("y", (F.col("label") == F.col("k")).cast("int"))
    return rank_auc(long, ["k"], "s", "y").agg(F.round(F.avg("auc"), 4).alias("auc_macro"), F.count("auc").alias("n_classes"))


PAIRS = """d AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS a, avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS b,
  CAST(round(100 * max(CASE WHEN l_linestatus = 'F' THEN l_discount END)) - round(100 * max(CASE WHEN l_linestatus = 'O' THEN l_discount END)) AS BIGINT) AS d
  FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2)"""


def pairs(spark, d):
    f, o = (F.when(F.col("l_linestatus") == s, F.col("l_discount")) for s in ("F", "O"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg(f).alias("a"), F.avg(o).alias("b"), (F.round(100 * F.max(f)) - F.round(100 * F.max(o))).cast("long").alias("d"))
    return g.filter("a is not null and b is not null")


@query("paired_ttest_stat", f"WITH {PAIRS} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(a - b), 6) AS mean, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t FROM d")
def paired_ttest_stat(spark, d):
    return T.ttest_statistic(pairs(spark, d), "a", "b").select("n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("wilcoxon_stat", f"""
WITH {PAIRS}, r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus,
  CAST(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS DOUBLE) AS w FROM r""")
def wilcoxon_stat(spark, d):
    return T.wilcoxon_statistic(pairs(spark, d), "d").select(*[F.col(c).cast("double") for c in ("w_plus", "w_minus", "w")])


@query("mcnemar_counts", f"""
WITH {DOCS}, c AS (SELECT count(*) FILTER (p <> y AND q = y) AS n01, count(*) FILTER (p = y AND q <> y) AS n10 FROM x)
SELECT CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, CAST(least(n01, n10) AS BIGINT) AS statistic FROM c""")
def mcnemar_counts(spark, d):
    return T.mcnemar_counts(docs(spark, d), "y", "p", "q")


STEPS = 2000
#: Simpson's rule over [0, upper] for each row of a table: weights 1, 4, 2, ..., 4, 1.
SIMPSON = f"(CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
SCORES = """d AS (SELECT l_orderkey % 4 AS g, CAST(round(100 * max(CASE WHEN l_linestatus = 'F' THEN l_discount END)) AS BIGINT) AS a,
  CAST(round(100 * max(CASE WHEN l_linestatus = 'O' THEN l_discount END)) AS BIGINT) AS b FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) = 2)"""


@query("paired_tests", f"""
WITH {SCORES}, m AS (SELECT g, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM d GROUP BY 1),
r AS (SELECT g, a - b AS d, rank() OVER (PARTITION BY g ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY g, abs(a - b)) - 1) / 2.0 AS r FROM d WHERE a <> b),
w AS (SELECT g, count(*) AS k, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY 1),
z AS (SELECT *, abs(w - k * (k + 1) / 4.0) / sqrt(k * (k + 1.0) * (2 * k + 1) / 24) AS z FROM w), i AS (SELECT unnest(range({STEPS + 1})) AS i),
p AS (SELECT g, 1 - 2 * sum({SIMPSON} * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * pow(1 + pow(t * i / {STEPS}, 2) / (n - 1), -n / 2.0)) * abs(any_value(t)) / {STEPS} / 3 AS p FROM m, i GROUP BY 1),
q AS (SELECT g, 1 - 2 * sum({SIMPSON} * exp(-pow(z * i / {STEPS}, 2) / 2) / sqrt(2 * pi())) * any_value(z) / {STEPS} / 3 AS q FROM z, i GROUP BY 1)
SELECT CAST(m.g AS BIGINT) AS g, CAST(n AS BIGINT) AS n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_b - mean_a, 6) AS delta, round(t, 5) AS t, round(abs(p), 5) AS ttest_p, p < 0.05 AS ttest_significant,
  w, round(abs(q), 5) AS wilcoxon_p FROM m JOIN p USING (g) JOIN z USING (g) JOIN q USING (g)""")
def paired_tests(spark, d):
    """Both paired tests of two scores in each group, with p-values and the flag of significance."""
    score = lambda s: F.round(100 * F.max(F.when(F.col("l_linestatus") == s, F.col("l_discount")))).cast("long")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(score("F").alias("a"), score("O").alias("b")).withColumn("g", F.col("l_orderkey") % 4)
    r = T.paired_tests(g, ["g"], "a", "b").withColumn("w", F.col("w").cast("double"))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b", "delta")}).withColumns({c: F.round(c, 5) for c in ("t", "ttest_p", "wilcoxon_p")})


@query("mcnemar_tests", """
WITH x AS (SELECT lang, quality AS y, CAST(n_chars > 1500 AS INTEGER) AS p, CASE WHEN lang <> 'de' THEN CAST(n_chars > 800 AS INTEGER) END AS q FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(q) AS n, count(*) FILTER (q IS NOT NULL AND p <> y AND q = y) AS n01, count(*) FILTER (q IS NOT NULL AND p = y AND q <> y) AS n10 FROM x GROUP BY 1),
p AS (SELECT lang, least(1, 2 * sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2)))) AS p FROM c, (SELECT unnest(range(100000)) AS i) i WHERE i <= least(n01, n10) AND n > 0 GROUP BY 1)
SELECT lang, CAST(n AS BIGINT) AS n, CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, CAST(least(n01, n10) AS BIGINT) AS statistic, round(p, 6) AS pvalue, p < 0.05 AS significant
FROM c LEFT JOIN p ON p.lang IS NOT DISTINCT FROM c.lang""".replace("SELECT lang, CAST(n", "SELECT c.lang, CAST(n"))
def mcnemar_tests(spark, d):
    """The exact test in each language; where a model made no predictions, p-value and flag are null."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    x = j.select("lang", F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), F.when(F.col("lang") != "de", (F.col("n_chars") > 800).cast("int")).alias("q"))
    return T.mcnemar(x, ["lang"], "y", "p", "q").withColumn("pvalue", F.round("pvalue", 6))
