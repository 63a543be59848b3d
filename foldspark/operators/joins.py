"""Joins on keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def join_nulls(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left and right joined on columns of one name, where null equals null; the columns come from left, once."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_right_{c}"]) for c in on])
    return left.join(right, same, how).drop(*[f"_right_{c}" for c in on])
