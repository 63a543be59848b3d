"""Connected components by alternating large and small stars, DataFrames only: no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import discard, small, written

#: Edges in a file, about; there are never more edges than at first.
EDGES = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours move to its least one. Small: its smaller neighbours and itself do."""
    if large:
        ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = ends.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): the component of each node with an edge, v its least node (nodes that are least themselves have no row)."""
    now = written(small(edges.filter("u <> v").distinct()))
    seen = None
    files = 1 + now.count() // EDGES
    while True:
        before, now = now, written(_star(_star(now, True), False).coalesce(files))
        discard(before)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now
        seen = state
