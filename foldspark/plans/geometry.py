"""Queries on class geometry and on how a sample stands for its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.operators import geometry as G
from foldspark.operators.ordered import ks
from foldspark.plans.catalog import query, table
from foldspark.plans.profiles import NUMERIC, long

FEATURES = ["l_quantity", "l_discount", "l_tax"]
LONG = """e AS (SELECT l_orderkey % 4 = 0 AS s, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS feature,
  unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE]) AS x FROM lineitem)"""


def sampled(spark, d):
    """Rows with s = 1 for a quarter of the orders: the sample under test."""
    return table(spark, d, "lineitem").withColumn("s", (F.col("l_orderkey") % 4 == 0).cast("int"))


@query("proportion_drift", """
WITH f AS (SELECT o_orderpriority AS l, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1),
s AS (SELECT o_orderpriority AS l, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_classes, round(max(abs(coalesce(f.p, 0) - coalesce(s.p, 0))), 6) AS max_abs_diff FROM f FULL JOIN s USING (l)""")
def proportion_drift(spark, d):
    o = table(spark, d, "orders")
    return G.proportion_drift(o, o.filter("o_orderkey % 4 = 0"), "o_orderpriority").withColumn("max_abs_diff", F.round("max_abs_diff", 6))


@query("feature_drift", f"""
WITH {LONG}, a AS (SELECT feature, avg(x) AS mf, stddev_pop(x) AS sf, avg(x) FILTER (s) AS ms, stddev_pop(x) FILTER (s) AS ss, max(x) = min(x) AS cf, max(x) FILTER (s) = min(x) FILTER (s) AS cs FROM e GROUP BY 1)
SELECT round(max(abs(ms - mf) / CASE WHEN cf THEN 1 ELSE sf END), 6) AS max_mean_shift, round(coalesce(max(CASE WHEN NOT cf THEN abs(ss / sf - 1) END), 0), 6) AS max_std_ratio_dev,
  CAST(count(*) FILTER (cf) AS BIGINT) AS constant_full, CAST(count(*) FILTER (cs) AS BIGINT) AS constant_sample FROM a""")
def feature_drift(spark, d):
    r = G.feature_drift(long(sampled(spark, d), NUMERIC, "s"))
    return r.withColumns({c: F.round(c, 6) for c in ("max_mean_shift", "max_std_ratio_dev")})


@query("ks_statistic", f"""
WITH {LONG}, c AS (SELECT feature, x, count(*) AS f, count(*) FILTER (s) AS n FROM e GROUP BY 1, 2),
r AS (SELECT feature, sum(f) OVER w / sum(f) OVER (PARTITION BY feature) AS pf, sum(n) OVER w / sum(n) OVER (PARTITION BY feature) AS ps FROM c WINDOW w AS (PARTITION BY feature ORDER BY x))
SELECT feature, round(max(abs(pf - ps)), 6) AS ks FROM r GROUP BY 1""")
def ks_statistic(spark, d):
    return ks(long(sampled(spark, d), NUMERIC, "s"), ["feature"], "x", "s").select("feature", F.round("ks", 6).alias("ks"))


@query("fisher_ratio", """
WITH e AS (SELECT c.label, l_returnflag = c.label AS own, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem, (SELECT DISTINCT l_returnflag AS label FROM lineitem) c),
a AS (SELECT label, pow(avg(q) FILTER (own) - avg(q) FILTER (NOT own), 2) + pow(avg(d) FILTER (own) - avg(d) FILTER (NOT own), 2) + pow(avg(t) FILTER (own) - avg(t) FILTER (NOT own), 2) AS b,
  var_pop(q) FILTER (own) + var_pop(q) FILTER (NOT own) + var_pop(d) FILTER (own) + var_pop(d) FILTER (NOT own) + var_pop(t) FILTER (own) + var_pop(t) FILTER (NOT own) AS w FROM e GROUP BY 1)
SELECT label, round(1000000 * b / w, 4) AS fisher_ppm FROM a""")
def fisher_ratio(spark, d):
    f = G.fisher(G.class_moments(table(spark, d, "lineitem"), "l_returnflag", FEATURES))
    return f.select("label", F.round(F.col("fisher") * 1_000_000, 4).alias("fisher_ppm"))


@query("centroid_distances", """
WITH m AS (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS k, unnest([v::DOUBLE FOR v IN embedding]) AS x FROM embeddings) GROUP BY 1, 2)
SELECT CAST(p.label AS INTEGER) AS a, CAST(q.label AS INTEGER) AS b, round(sqrt(sum(pow(p.m - q.m, 2))), 6) AS distance FROM m p JOIN m q USING (k) GROUP BY 1, 2""")
def centroid_distances(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return G.centroid_distances(e, "label", "x").select(F.col("a").cast("int"), F.col("b").cast("int"), F.round("distance", 6).alias("distance"))


@query("silhouette", """
WITH e AS (SELECT vec_id AS i, label AS y, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings), n AS (SELECT y, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT p.i, p.y AS own, q.y AS other, sum(CASE WHEN p.i <> q.i THEN list_distance(p.x, q.x) ELSE 0 END) AS s FROM e p, e q GROUP BY ALL),
r AS (SELECT i, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM s JOIN n ON n.y = s.other GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 5) AS silhouette FROM r""")
def silhouette(spark, d):
    """Over all components and all rows."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return G.silhouette(e, "vec_id", "x", "label").select(F.round("silhouette", 5).alias("silhouette"))


@query("geometry_by_group", """
WITH e AS (SELECT f.k AS fold, l_returnflag = c.label AS own, c.label, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem, (SELECT DISTINCT l_returnflag AS label FROM lineitem) c, (SELECT unnest(range(5)) AS k) f WHERE l_orderkey % 5 <> f.k),
a AS (SELECT fold, label, pow(avg(q) FILTER (own) - avg(q) FILTER (NOT own), 2) + pow(avg(d) FILTER (own) - avg(d) FILTER (NOT own), 2) + pow(avg(t) FILTER (own) - avg(t) FILTER (NOT own), 2) AS b,
  var_pop(q) FILTER (own) + var_pop(q) FILTER (NOT own) + var_pop(d) FILTER (own) + var_pop(d) FILTER (NOT own) + var_pop(t) FILTER (own) + var_pop(t) FILTER (NOT own) AS w FROM e GROUP BY 1, 2)
SELECT label, round(avg(1000000 * b / w), 4) AS mean_ppm, round(stddev_pop(1000000 * b / w), 3) AS std_ppm, round(min(1000000 * b / w), 4) AS min_ppm FROM a GROUP BY 1""")
def geometry_by_group(spark, d):
    """Separability on the training rows of each fold, summed up over folds. Moments are taken by (fold, class) and combined."""
    df = table(spark, d, "lineitem").withColumn("g", F.struct((F.col("l_orderkey") % 5).cast("int").alias("own"), F.col("l_returnflag").alias("label")))
    m = G.class_moments(df, "g", FEATURES).select("label.own", F.col("label.label").alias("label"), "n", "feature", "mean", "var")
    m = m.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("own <> fold")
    n, mean = F.col("n"), F.col("mean")
    total = m.groupBy("fold", "label", "feature").agg(F.sum("n").alias("N"), F.sum(n * mean).alias("S"), F.sum(n * (F.col("var") + mean * mean)).alias("Q"))
    m = total.select("fold", "label", "feature", F.col("N").alias("n"), (F.col("S") / F.col("N")).alias("mean"), (F.col("Q") / F.col("N") - (F.col("S") / F.col("N")) ** 2).alias("var"))
    f = G.fisher(m, ("fold",)).withColumn("ppm", F.col("fisher") * 1_000_000)
    return f.groupBy("label").agg(F.round(F.avg("ppm"), 4).alias("mean_ppm"), F.round(F.stddev_pop("ppm"), 3).alias("std_ppm"), F.round(F.min("ppm"), 4).alias("min_ppm"))


@query("representativeness", f"""
WITH {LONG}, a AS (SELECT feature, avg(x) AS mf, stddev_pop(x) AS sf, avg(x) FILTER (s) AS ms, stddev_pop(x) FILTER (s) AS ss, max(x) = min(x) AS cf, max(x) FILTER (s) = min(x) FILTER (s) AS cs FROM e GROUP BY 1),
m AS (SELECT max(abs(ms - mf) / CASE WHEN cf THEN 1 ELSE sf END) AS shift, coalesce(max(CASE WHEN NOT cf THEN abs(ss / sf - 1) END), 0) AS ratio FROM a),
c AS (SELECT feature, x, count(*) AS f, count(*) FILTER (s) AS n FROM e GROUP BY 1, 2),
r AS (SELECT feature, sum(f) OVER w / sum(f) OVER (PARTITION BY feature) AS pf, sum(n) OVER w / sum(n) OVER (PARTITION BY feature) AS ps FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
z AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (l_orderkey % 4 = 0)::DOUBLE AS m FROM lineitem), k AS (SELECT feature, max(abs(pf - ps)) * (SELECT sqrt(n * m / (n + m)) FROM z) AS x FROM r GROUP BY 1),
p AS (SELECT feature, any_value(x) AS x, 2 * sum(pow(-1, i - 1) * exp(-2 * i * i * x * x)) AS p FROM k, (SELECT unnest(range(1, 101)) AS i) GROUP BY 1),
g AS (SELECT l_returnflag AS l, count(*) / sum(count(*)) OVER () AS q FROM lineitem GROUP BY 1), h AS (SELECT l_returnflag AS l, count(*) / sum(count(*)) OVER () AS q FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM g) AS n_classes, (SELECT round(max(abs(coalesce(g.q, 0) - coalesce(h.q, 0))), 6) FROM g FULL JOIN h USING (l)) AS max_abs_diff, round(shift, 6) AS max_mean_shift, round(ratio, 6) AS max_std_ratio_dev,
  (SELECT CAST(count(*) AS BIGINT) FROM p) AS n_features, (SELECT CAST(count(*) FILTER (x >= 0.2 AND p < 0.05) AS BIGINT) FROM p) AS n_reject, (SELECT round(0.05 * count(*), 6)::DOUBLE FROM p) AS expected_rejects FROM m""")
def representativeness(spark, d):
    """How the sample stands for the table, in one row: class shares, moments, and rejected distributions against chance."""
    r = G.representativeness(sampled(spark, d), "l_returnflag", list(NUMERIC), "s")
    r = r.select("n_classes", "max_abs_diff", "max_mean_shift", "max_std_ratio_dev", "n_features", "n_reject", F.col("expected_rejects").cast("double").alias("expected_rejects"))
    return r.withColumns({c: F.round(c, 6) for c in ("max_abs_diff", "max_mean_shift", "max_std_ratio_dev", "expected_rejects")})
