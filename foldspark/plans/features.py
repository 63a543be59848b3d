"""Queries on feature engineering: fitted on training rows, applied to all."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foldspark.functions import scalars as S
from foldspark.operators import features as X
from foldspark.operators.hashing import ADDED, FINAL, FIRST, MASK, SECOND, hash_tokens
from foldspark.plans.catalog import query, table

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("standardize", """
WITH f AS (SELECT k AS fold, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem, (SELECT unnest(range(5)) AS k) WHERE l_orderkey % 5 <> k GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg((l_quantity - m) / s), 5) AS mean_z, round(max((l_quantity - m) / s), 5) AS max_z FROM lineitem JOIN f ON l_orderkey % 5 = fold GROUP BY 1""")
def standardize(spark, d):
    """Held-out rows on the scale of their training rows; all folds are fitted in one pass."""
    df = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_quantity")
    z = X.standardize(df, X.fit_moments(df, ["l_quantity"], 5), ["l_quantity"])
    return z.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity_z"), 5).alias("mean_z"), F.round(F.max("l_quantity_z"), 5).alias("max_z"))


@query("minmax_clip", f"""
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), f AS (SELECT k, min(x) AS lo, max(x) AS hi FROM e WHERE vec_id % 4 <> 0 GROUP BY 1)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(CASE WHEN hi > lo THEN greatest(0.0, least({math.pi!r}::DOUBLE, (x - lo) / (hi - lo) * {math.pi!r}::DOUBLE)) ELSE 0 END, 6) AS x FROM e JOIN f USING (k)""")
def minmax_clip(spark, d):
    """Every component scaled by the training rows and clipped; the fit has a row for each component."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("k", "x"))
    fit = e.filter("vec_id % 4 <> 0").groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return e.join(F.broadcast(fit), "k").select("vec_id", "k", F.round(S.minmax(F.col("x"), F.col("lo"), F.col("hi")), 6).alias("x"))


@query("pad_normalize", """
WITH e AS (SELECT vec_id, unnest(range(72)) AS k, unnest(list_concat([x::DOUBLE FOR x IN embedding], [0.0::DOUBLE FOR i IN range(8)])) AS x, sqrt(list_sum([x::DOUBLE * x FOR x IN embedding])) AS n FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(x / n, 6) AS x FROM e WHERE k < 72""")
def pad_normalize(spark, d):
    """All 64 components padded to 72 and brought to unit length."""
    e = table(spark, d, "embeddings").select("vec_id", S.pad_normalize(F.col("embedding"), 72).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("k", "x")).select("vec_id", "k", F.round("x", 6).alias("x"))


@query("balanced_weights", """
WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n.n), 6) AS weight FROM labels JOIN n USING (quality)""")
def balanced_weights(spark, d):
    return X.balanced_weights(table(spark, d, "labels"), "quality").select("doc_id", F.round("weight", 6).alias("weight"))


@query("l1_histogram", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type)
SELECT u.user_id, t.event_type, round(coalesce(c.n, 0) / s.n, 6) AS share FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN t
JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) s ON s.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type""")
def l1_histogram(spark, d):
    types = ("click", "error", "purchase", "signup", "view")
    u = table(spark, d, "events").groupBy("user_id").agg(F.array(*[F.count_if(F.col("event_type") == t).cast("double") for t in types]).alias("h"))
    u = u.withColumn("h", S.l1_normalize(F.col("h")))
    return u.select("user_id", F.posexplode("h").alias("i", "share")).select(
        "user_id", F.element_at(F.array(*[F.lit(t) for t in types]), F.col("i") + 1).alias("event_type"), F.round("share", 6).alias("share"))


@query("struct_to_vector", """
SELECT o_orderkey, o_custkey::DOUBLE AS v0, o_totalprice AS v1, date_part('year', o_orderdate)::DOUBLE AS v2, CAST(o_orderstatus = 'F' AS INTEGER)::DOUBLE AS v3 FROM orders""")
def struct_to_vector(spark, d):
    """A nested record's scalars in a fixed order."""
    o = table(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("done")).alias("r"))
    v = o.select("o_orderkey", X.to_vector("r", ["o_custkey", "o_totalprice", "year", "done"]).alias("v"))
    return v.select("o_orderkey", *[F.col("v")[i].alias(f"v{i}") for i in range(4)])


@query("array_struct_counts", """
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_tax = 0) AS BIGINT) AS n_zero, CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS BIGINT) AS n_both,
  CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS n_write FROM lineitem GROUP BY 1""")
def array_struct_counts(spark, d):
    """Counts over an array of records, each with an array of properties."""
    record = F.struct("l_tax", F.array(F.concat(F.lit("flag_"), "l_returnflag"), F.concat(F.lit("status_"), "l_linestatus")).alias("props"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(record).alias("s"))
    n = lambda f: F.size(F.filter("s", f)).cast("long")
    return o.select(
        "l_orderkey", F.size("s").cast("long").alias("n"), n(lambda x: x["l_tax"] == 0).alias("n_zero"),
        n(lambda x: F.array_contains(x["props"], "flag_R") & F.array_contains(x["props"], "status_F")).alias("n_both"), n(lambda x: F.array_contains(x["props"], "flag_N")).alias("n_write"))


@query("map_flatten_tokens", """
WITH t AS (SELECT DISTINCT conv_id, lower(role) AS name, lower(role) || ':' || turn AS token FROM conversations)
SELECT conv_id, token, CAST(count(DISTINCT name) OVER (PARTITION BY conv_id) AS BIGINT) AS n_names FROM t""".replace("count(DISTINCT name) OVER (PARTITION BY conv_id)", "(SELECT count(DISTINCT u.name) FROM t u WHERE u.conv_id = t.conv_id)"))
def map_flatten_tokens(spark, d):
    """Every token key:value of a map of arrays, and how many distinct lower-case keys it has. Keys come in upper case here."""
    c = table(spark, d, "conversations").select("conv_id", F.upper("role").alias("role"), F.col("turn").cast("string").alias("turn")).distinct()
    m = c.groupBy("conv_id", "role").agg(F.collect_list("turn").alias("turns")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "turns"))).alias("m"))
    t = m.select("conv_id", *X.map_tokens("m"))
    return t.select("conv_id", F.explode("tokens").alias("token"), F.size("names").cast("long").alias("n_names"))


@query("interleave_pad", """
SELECT vec_id, CAST(unnest(range(70)) AS INTEGER) AS k, round(unnest(list_concat([x::DOUBLE FOR x IN embedding], [0.0::DOUBLE FOR i IN range(6)])), 6) AS v FROM embeddings""")
def interleave_pad(spark, d):
    """Pairs laid side by side, padded to a fixed number of pairs."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.col("embedding")[2 * i].cast("double").alias("a"), F.col("embedding")[2 * i + 1].cast("double").alias("b")))
    e = table(spark, d, "embeddings").select("vec_id", pairs.alias("p")).select("vec_id", F.posexplode(X.interleave("p", 35)).alias("k", "v"))
    return e.select("vec_id", "k", F.round("v", 6).alias("v"))


def _murmur_sql() -> str:
    """(w, h): signed 32-bit hashes of the words of a table u, word by word of four bytes, in 64-bit arithmetic."""
    times = lambda x, c: f"((({x} & 65535) * {c} + (((({x} >> 16) * {c}) & 65535) * 65536)) & {MASK})"
    turned = lambda x, by: f"((({x} << {by}) | ({x} >> {32 - by})) & {MASK})"
    number = lambda *at: "('0x' || " + " || ".join(f"substr(x, {i}, 2)" for i in at) + ")::BIGINT"
    rest = f"CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN {number('2 * n - 1')} WHEN 2 THEN {number('2 * n - 1', '2 * n - 3')} ELSE {number('2 * n - 1', '2 * n - 3', '2 * n - 5')} END"
    mixed = lambda c: f"list_transform(list_transform(list_transform({c}, lambda k: {times('k', FIRST)}), lambda k: {turned('k', 15)}), lambda k: {times('k', SECOND)})"
    steps = [
        "b AS (SELECT w, hex(encode(w)) AS x, strlen(w)::BIGINT AS n FROM u)",
        f"b1 AS (SELECT w, n, {mixed(f'list_transform(range(n // 4), lambda i: {number(*(f"8 * i + {k}" for k in (7, 5, 3, 1)))})')} AS m, {mixed(f'[{rest}]')}[1] AS last FROM b)",
        f"b2 AS (SELECT w, xor(xor(list_reduce(list_prepend(0::BIGINT, m), lambda h, k: ({turned('xor(h, k)', 13)} * 5 + {ADDED}) & {MASK}), last), n) AS h FROM b1)"]
    last = "b2"
    for i, (shift, factor) in enumerate(FINAL):
        steps.append(f"b{3 + i} AS (SELECT w, {times(f'xor(h, h >> {shift})', factor)} AS h FROM {last})")
        last = f"b{3 + i}"
    return ",\n".join(steps) + f", h AS (SELECT w, CASE WHEN xor(h, h >> 16) >= 2147483648 THEN xor(h, h >> 16) - 4294967296 ELSE xor(h, h >> 16) END AS h FROM {last})"


@query("signed_hash", f"""
WITH t AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents), u AS (SELECT DISTINCT w FROM t), {_murmur_sql()},
s AS (SELECT doc_id, abs(h) % 16 AS bin, sum(sign(h + 0.5))::DOUBLE AS v FROM t JOIN h USING (w) GROUP BY ALL)
SELECT doc_id, bin::INT AS bin, v FROM s WHERE v <> 0""")
def signed_hash(spark, d):
    """Words of each document hashed with signs into 16 bins: those that aren't 0."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+").alias("tokens"))
    return docs.select("doc_id", F.posexplode(hash_tokens("tokens", 16)).alias("bin", "v")).filter("v <> 0")


CHAIN = """x AS (SELECT l_orderkey % 3 AS g, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, 2 * l_quantity::DOUBLE + l_tax AS c, l_discount::DOUBLE AS d, l_tax::DOUBLE AS e, 1.0::DOUBLE AS k FROM lineitem),
f AS (SELECT unnest(range(3)) AS fold), t AS (SELECT fold, x.* FROM x, f WHERE g <> fold)"""


def _greedy_sql(columns: str, threshold: float) -> str:
    """Which columns go: each whose correlation with an earlier one that stays is above the threshold."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    steps, last = [f"r AS (SELECT fold, {', '.join(f'abs(corr({a}, {b})) > {threshold} AS {a}{b}' for a, b in pairs)} FROM t GROUP BY 1)", "s0 AS (SELECT *, false AS x_a FROM r)"], "s0"
    for i, b in enumerate(columns[1:], 1):
        steps.append(f"s{i} AS (SELECT *, {' OR '.join(f'(NOT x_{a} AND {a}{b})' for a in columns[:i])} AS x_{b} FROM {last})")
        last = f"s{i}"
    kept = " || ".join(f"CASE WHEN x_{c} THEN '' ELSE '{c}' END" for c in columns)
    return ",\n".join(steps) + f"\nSELECT CAST(fold AS INTEGER) AS fold, {kept} AS kept FROM {last}"


def chain_rows(spark, d):
    c = lambda name: F.col(name).cast("double")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 3).cast("int").alias("fold"), c("l_quantity").alias("a"), c("l_extendedprice").alias("b"), (2 * c("l_quantity") + F.col("l_tax")).alias("c"),
        c("l_discount").alias("d"), c("l_tax").alias("e"), F.lit(1.0).alias("k"))


@query("greedy_correlation", f"WITH {CHAIN}, {_greedy_sql('abcde', 0.95)}")
def greedy_correlation(spark, d):
    """Columns that each fold's training rows keep: none that is constant, and none that goes with an earlier kept one."""
    chain = X.Chain(chain_rows(spark, d), list("abcdek"), 1)
    return spark.createDataFrame([(f, "".join(v["kept"])) for f, v in chain.fits.items()], "fold int, kept string")


@query("chain_projection", f"""
WITH {CHAIN}, r AS (SELECT fold, corr(a, d) AS r, avg(a) AS ma, stddev_pop(a) AS sa, avg(d) AS md, stddev_pop(d) AS sd FROM t GROUP BY 1),
z AS (SELECT r.fold, r, ((a - ma) / sa + sign(r) * (d - md) / sd) / sqrt(2) AS z FROM x JOIN r ON x.g = r.fold)
SELECT CAST(fold AS INTEGER) AS fold, round((1 + abs(any_value(r))) / 2, 6) AS explained, round(avg(z * z), 4) AS size, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY 1""")
def chain_projection(spark, d):
    """Held-out rows through the chain that is fitted on the other folds: of two columns that stay, the first component."""
    rows = chain_rows(spark, d).select("fold", "a", "c", "d", "k")
    z = X.Chain(rows, ["a", "c", "d", "k"], 1).transform(rows)
    return z.groupBy("fold").agg(F.round(F.first("explained")[0], 6).alias("explained"), F.round(F.avg(F.col("z")[0] * F.col("z")[0]), 4).alias("size"), F.count("*").alias("n"))


@query("column_stitch", "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS f0, round(embedding[2]::DOUBLE, 6) AS f1 FROM embeddings")
def column_stitch(spark, d):
    """Tables of columns side by side, by key."""
    e = table(spark, d, "embeddings")
    first, second = (e.select("vec_id", F.round(F.col("embedding")[i].cast("double"), 6).alias(f"f{i}")) for i in (0, 1))
    return X.stitch([e.select("vec_id", "label"), first, second], "vec_id")
