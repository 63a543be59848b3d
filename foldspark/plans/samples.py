"""Queries on folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspark.functions.scalars import lcg
from foldspark.operators import sampling as P
from foldspark.plans.catalog import query, table

LCG = "({k}::BIGINT * 48271 + 42) % 2147483647"


@query("strat_folds", f"""
SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {LCG.format(k='o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders""")
def strat_folds(spark, d):
    return P.folds(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5).select("o_orderkey", "o_orderpriority", "fold")


def _quota(source: str, stratum: str, total: str) -> str:
    return f"""n AS (SELECT {stratum} AS s, count(*)::BIGINT AS n FROM {source} GROUP BY 1),
a AS (SELECT sum(n)::BIGINT AS all_n, least(({total})::BIGINT, sum(n)::BIGINT) AS want FROM n),
w AS (SELECT s, n * want // all_n AS whole, n * want % all_n AS rest, want FROM n, a),
q AS (SELECT s, whole + (row_number() OVER (ORDER BY rest DESC, s) <= want - sum(whole) OVER ())::BIGINT AS quota FROM w)"""


@query("strat_subsample", f"""
WITH {_quota('orders', 'o_orderstatus', '1000')},
r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {LCG.format(k='o_orderkey')}, o_orderkey) AS rank FROM orders)
SELECT o_orderkey, o_orderstatus FROM r JOIN q ON o_orderstatus = s WHERE rank <= quota""")
def strat_subsample(spark, d):
    return P.subsample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 1000).select("o_orderkey", "o_orderstatus")


@query("strat_holdout", f"""
WITH {_quota('embeddings', 'label', 'SELECT count(*) // 4 FROM embeddings')},
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {LCG.format(k='vec_id')}, vec_id) AS rank FROM embeddings)
SELECT vec_id, label, rank <= quota AS held_out FROM r JOIN q ON label = s""")
def strat_holdout(spark, d):
    """A quarter of each class held out."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return P.holdout(e, "label", "vec_id", e.count() // 4).select("vec_id", "label", "held_out")


@query("balanced_topk_pool", f"""
WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 100 ORDER BY n DESC, event_type LIMIT 3),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {LCG.format(k='event_id')}, event_id) AS rank FROM events WHERE event_type IN (SELECT event_type FROM t))
SELECT event_id, event_type FROM r WHERE rank <= (SELECT min(n) FROM t)""")
def balanced_topk_pool(spark, d):
    return P.balanced(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 100, 3).select("event_id", "event_type")


@query("pool_union", f"""
WITH h AS (SELECT least(100, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')) AS half),
p AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {LCG.format(k='o_orderkey')}, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'), h WHERE r <= half),
m AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {LCG.format(k='o_orderkey')}, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O'), h WHERE r <= half),
t AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 2),
f AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {LCG.format(k='o_orderkey')}, o_orderkey) AS r
      FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN (SELECT o_orderpriority FROM t)) WHERE r <= (SELECT min(n) FROM t))
SELECT o_orderkey FROM p UNION SELECT o_orderkey FROM m UNION SELECT o_orderkey FROM f""")
def pool_union(spark, d):
    """The balanced family pool of the positive rows and a half-and-half binary pool, together."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    n = {r["o_orderstatus"]: r["count"] for r in o.groupBy("o_orderstatus").count().collect()}
    half = min(100, n.get("F", 0), n.get("O", 0))
    binary = [P.first_by_hash(o, F.col("o_orderstatus") == s, "o_orderkey", half).select("o_orderkey") for s in ("F", "O")]
    families = P.balanced(o.filter("o_orderstatus = 'F'"), "o_orderpriority", "o_orderkey", 1, 2).select("o_orderkey")
    return binary[0].union(binary[1]).union(families).distinct()


@query("sample_gather", f"""
WITH s AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY {LCG.format(k='vec_id')}, vec_id) - 1 AS INTEGER) AS sample_pos FROM embeddings)
SELECT s.sample_pos, e.vec_id, e.label, round(e.embedding[1]::DOUBLE, 6) AS f1 FROM s JOIN embeddings e USING (vec_id) WHERE sample_pos < 50""")
def sample_gather(spark, d):
    """Rows of a stored sample with their places in it: the sample is an array of keys, as read from a file."""
    e = table(spark, d, "embeddings")
    picked = P.first_by_hash(e.select("vec_id"), F.lit(True), "vec_id", 50).agg(F.sort_array(F.collect_list(F.struct(lcg(F.col("vec_id")).alias("h"), "vec_id"))).alias("s"))
    keys = picked.select(F.posexplode("s.vec_id").alias("sample_pos", "vec_id"))
    return e.join(F.broadcast(keys), "vec_id").select("sample_pos", "vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("f1"))


@query("topk_families", """
SELECT p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type HAVING count(*) >= 10 ORDER BY n DESC, p_type LIMIT 5""")
def topk_families(spark, d):
    return P.top_groups(table(spark, d, "part"), "p_type", 10, 5)
