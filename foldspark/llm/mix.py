"""Mixing sources to target weights (DataFrame functions only).

Tokens are aggregated per source, targets come from water-filling, and each document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate.

Cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, after the others;
repeated rows draw the same coin, as the coin depends on doc_id alone (null doc_id: a coin of its own); an empty table
gives no rows; further columns are ignored by `mix` and carried by `copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: The table of sources is broadcast up to this many rows; beyond, documents and sources meet in a shuffled join.
BROADCAST_SOURCES = 20_000


def coin(doc_id: Column) -> Column:
    """A fraction in [0, 1) from the md5 of a document's id."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def targets(sized: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Water-filling: target = min(weight * level, 2 * size) with the level at which targets sum to 150% of all sizes.
    Sources sorted by 2 * size / weight fill up in that order, so the level is a running sum over sources away. One row
    a source is left by then, however many documents the source has.
    """
    s = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    level = F.try_divide(
        F.col("total") * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(after)
    )
    s = s.withColumn("total", total).withColumn("level", level)
    # the level that holds is the first whose own source isn't full at it; all levels before it overfill their source
    full = F.col("cap") <= F.col("weight") * F.col("level")
    rank = F.row_number().over(filling)
    s = s.withColumn("open_at", F.when(~full, F.struct(rank.alias("rank"), F.col("level").alias("level"))))
    s = s.withColumn("held", F.min("open_at").over(Window.partitionBy(F.lit(1)))["level"])
    target = F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("held")))
    return s.select("source", "source_size", target.alias("target"))


def _with_rates(docs: DataFrame) -> DataFrame:
    """docs with mix_source, mix_size, mix_source_size, mix_target, mix_copies."""
    sized = docs.withColumn("mix_size", word_count(F.col("text")))
    rates = written(targets(sized.select("source", F.col("mix_size").alias("size"))))
    rates = rates.select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size")), F.lit(0.0))
    joined = sized.join(rates, sized["source"].eqNullSafe(rates["mix_source"]), "left")
    whole = F.floor(rate)
    return joined.withColumn("mix_copies", (whole + F.when(coin(F.col("doc_id")) < rate - whole, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """Each document's size, its source's size and target, and the words that the mix takes of it."""
    m = _with_rates(docs.select("doc_id", "text", "source"))
    return m.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
    )


def copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of docs."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("mix_row"), "doc_id", "text", "source")
    m = _with_rates(packed).filter("mix_copies > 0").select("mix_row", "mix_copies")
    return m.select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("mix_row.*")
