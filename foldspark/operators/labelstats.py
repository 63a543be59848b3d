"""Dominant tags and their statistics; the statistics of parts add up to those of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(tags: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(t), F.lit(0)).cast("long") for t in tags])


def dominant(df: DataFrame, tags: list[str]) -> DataFrame:
    """Rows with any tag, and `dominant_tag`: the one with the largest count, the first declared of equal ones."""
    c = _counts(tags)
    place = F.array_position(c, F.array_max(c)).cast("int")
    return df.filter(F.array_max(c) > 0).withColumn("dominant_tag", F.element_at(F.array(*[F.lit(t) for t in tags]), place))


def stats(df: DataFrame, tags: list[str]) -> DataFrame:
    """One row: all rows, those without a tag, those with one, and those whose largest count is tied."""
    r = df.select(_counts(tags).alias("c")).select("c", F.array_max("c").alias("top"))
    tied = F.size(F.filter("c", lambda x: x == F.col("top"))) > 1
    return r.agg(
        F.count("*").alias("total"), F.count_if(F.col("top") == 0).alias("dropped"), F.count_if(F.col("top") > 0).alias("labelled"),
        F.count_if((F.col("top") > 0) & tied).alias("tied"))


def merge(parts: DataFrame) -> DataFrame:
    """Statistics of the whole from those of its parts."""
    return parts.agg(*[F.sum(c).alias(c) for c in ("total", "dropped", "labelled", "tied")])
