"""Queries that profile tables: counts, moments, correlations, tag statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspark.functions.scalars import correlation
from foldspark.operators import labelstats as L
from foldspark.operators import sketches as K
from foldspark.operators.ordered import rank_auc
from foldspark.plans.catalog import query, table

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
TAGS = ("click", "error", "purchase", "signup", "view")
USERS = "u AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}' AND value > 90) AS {t}" for t in TAGS) + " FROM events GROUP BY 1)"


def users(spark, d):
    """Tag counts of each user, as columns."""
    return table(spark, d, "events").groupBy("user_id").agg(*[F.count_if((F.col("event_type") == t) & (F.col("value") > 90)).alias(t) for t in TAGS])


def long(df, columns, *keep):
    """One row for each column's value."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select(*keep, "e.*")


@query("value_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("fold_aggregate", """
SELECT l_returnflag, round(avg(l_discount), 6) AS f1_mean, round(stddev_pop(l_discount), 6) AS f1_std, round(avg(l_tax), 6) AS accuracy_mean, round(stddev_pop(l_tax), 6) AS accuracy_std
FROM lineitem GROUP BY 1""")
def fold_aggregate(spark, d):
    """Mean and population deviation of each metric."""
    metrics = {"f1": "l_discount", "accuracy": "l_tax"}
    aggs = [F.round(f(c), 6).alias(f"{m}_{s}") for m, c in metrics.items() for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*aggs)


@query("label_stats", f"""
WITH {USERS}, m AS (SELECT *, greatest({', '.join(TAGS)}) AS top FROM u)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (top = 0) AS BIGINT) AS dropped, CAST(count(*) FILTER (top > 0) AS BIGINT) AS labelled,
  CAST(count(*) FILTER (top > 0 AND {' + '.join(f'({t} = top)::INT' for t in TAGS)} > 1) AS BIGINT) AS tied FROM m""")
def label_stats(spark, d):
    return L.stats(users(spark, d), list(TAGS))


@query("dominant_tag", f"""
WITH {USERS}, m AS (SELECT *, greatest({', '.join(TAGS)}) AS top FROM u)
SELECT user_id, CASE {' '.join(f"WHEN {t} = top THEN '{t}'" for t in TAGS)} END AS dominant_tag FROM m WHERE top > 0""")
def dominant_tag(spark, d):
    return L.dominant(users(spark, d), list(TAGS)).select("user_id", "dominant_tag")


@query("describe_counts", """
SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY 1""")
def describe_counts(spark, d):
    q = [F.round(F.percentile("value", F.lit(p)), 6).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), *q, F.max("value").alias("max"))


@query("variance_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp({c}), 4) AS variance, var_samp({c}) < 1e-8 AS near_zero FROM (SELECT *, 7 AS constant FROM lineitem)" for c in (*NUMERIC, "constant")))
def variance_profile(spark, d):
    """Sample variances from one scan, then one row for each column."""
    df = table(spark, d, "lineitem").withColumn("constant", F.lit(7))
    one = df.agg(*[F.var_samp(c).alias(c) for c in (*NUMERIC, "constant")])
    return long(one, (*NUMERIC, "constant")).select("feature", F.round("x", 4).alias("variance"), (F.col("x") < 1e-8).alias("near_zero"))


@query("variance_filter", " UNION ALL ".join(
    f"SELECT '{c}' AS feature FROM (SELECT *, 7 AS constant FROM lineitem WHERE l_orderkey % 5 <> 0) HAVING max({c}) > min({c})" for c in (*NUMERIC, "constant")))
def variance_filter(spark, d):
    """Columns that vary in the training rows, by their extremes, which is exact."""
    df = table(spark, d, "lineitem").filter("l_orderkey % 5 <> 0").withColumn("constant", F.lit(7))
    one = df.agg(*[(F.max(c) > F.min(c)).cast("double").alias(c) for c in (*NUMERIC, "constant")])
    return long(one, (*NUMERIC, "constant")).filter("x > 0").select("feature")


PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


def correlations(spark, d):
    """All pairs from one scan."""
    df = table(spark, d, "lineitem")
    one = df.agg(*[correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}:{b}") for a, b in PAIRS])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}:{b}`").alias("r")) for a, b in PAIRS])
    return one.select(F.explode(rows).alias("e")).select("e.*")


@query("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def corr_pairs(spark, d):
    return correlations(spark, d).withColumn("r", F.round("r", 6))


@query("top_corr_pairs", "SELECT a, b, r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM lineitem" for a, b in PAIRS) + ") ORDER BY r DESC, a, b LIMIT 5")
def top_corr_pairs(spark, d):
    return correlations(spark, d).withColumn("r", F.round(F.abs("r"), 6)).orderBy(F.desc("r"), "a", "b").limit(5)


@query("univariate_auc", """
WITH e AS (SELECT CAST(l_linestatus = 'F' AS INTEGER) AS y, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS feature,
  unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE]) AS x FROM lineitem),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM e),
a AS (SELECT feature, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1)
SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc FROM a""")
def univariate_auc(spark, d):
    """Each column alone as a score, folded to at least a half."""
    df = table(spark, d, "lineitem").withColumn("y", (F.col("l_linestatus") == "F").cast("int"))
    a = rank_auc(long(df, NUMERIC, "y"), ["feature"], "x", "y")
    return a.select("feature", F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("auc"))


@query("power_law_fit", """
WITH p AS (SELECT l_linenumber AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT round(regr_slope(ln(s), ln(n)), 6) AS exponent, CAST(count(*) AS BIGINT) AS n_points FROM p WHERE s > 0 AND n > 0""")
def power_law_fit(spark, d):
    """Slope of a straight line through logarithms; null with fewer than two positive points."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.sum("l_extendedprice").alias("s")).filter("s > 0 and n > 0")
    slope = F.when(F.count("*") >= 2, F.regr_slope(F.log("s"), F.log("n")))
    return p.agg(F.round(slope, 6).alias("exponent"), F.count("*").alias("n_points"))


@query("describe_from_states", """
WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY 1)
SELECT event_type, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS min, round(most, 6) AS max, CAST(3 AS BIGINT) AS quartiles_within FROM s WHERE n > 0""")
def describe_from_states(spark, d):
    """Values of each event type from sketches of 16 chunks, merged; quartiles whose rank is within the stated error of their share."""
    e = table(spark, d, "events").select("event_type", "value", F.pmod("event_id", F.lit(16)).alias("chunk"))
    got = K.describe(K.merge(K.states(e, ["event_type", "chunk"], "value").drop("chunk"), ["event_type"]), ["event_type"])
    names = dict(zip(("q25", "q50", "q75"), K.QUARTILES, strict=True))
    counts = [F.count_if(F.col("value") < F.col(c)).alias(f"below_{c}") for c in names] + [F.count_if(F.col("value") <= F.col(c)).alias(f"upto_{c}") for c in names]
    ranked = e.join(got, "event_type").groupBy("event_type", "n", "mean", "std", "min", "max").agg(*counts)
    within = [((F.col(f"below_{c}") / F.col("n") - K.rank_error() <= q) & (F.col(f"upto_{c}") / F.col("n") + K.rank_error() >= q)).cast("long") for c, q in names.items()]
    return ranked.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], (within[0] + within[1] + within[2]).alias("quartiles_within"))
