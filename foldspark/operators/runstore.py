"""Operators on a store of hierarchical runs: sweeps (parents) with a run for each fold (children)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.scalars import sweep_encoding

REQUIRED = ("run_id", "parent_run_id", "status", "start_time")


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"the run store lacks the columns {', '.join(missing)}; export it again with all parameters and metrics")
    return df


def flat(store: DataFrame, metrics: list[str], params: list[str]) -> DataFrame:
    """Maps spread to columns metrics_* and params_*; other keys are left out."""
    require(store)
    return store.select(
        *REQUIRED, *[F.col("metrics")[m].alias(f"metrics_{m}") for m in metrics], *[F.col("params")[p].alias(f"params_{p}") for p in params])


def clean_sweeps(children: DataFrame, parents: DataFrame, folds: int, metric: str = "f1_macro") -> DataFrame:
    """(parent_run_id) of finished sweeps with exactly `folds` children that have the metric. The one rule for all consumers."""
    sized = children.filter(F.col(metric).isNotNull()).groupBy("parent_run_id").count().filter(F.col("count") == folds)
    done = parents.filter("status = 'FINISHED'").select(F.col("run_id").alias("parent_run_id"))
    return sized.select("parent_run_id").join(done, "parent_run_id", "left_semi")


def newest(runs: DataFrame, *by: str) -> DataFrame:
    """The run that started last for each key (ties: the larger run_id): an arg-max aggregate, so no group is sorted."""
    rest = [c for c in runs.columns if c not in by and c not in ("start_time", "run_id")]
    last = F.max(F.struct("start_time", "run_id", *rest)).alias("last")
    return runs.groupBy(*by).agg(last).select(*by, "last.*")


def fold_numbers(children: DataFrame, ties: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """children with fold_no: their order of start within a sweep, ties by the columns that tell rows apart."""
    order = Window.partitionBy("parent_run_id").orderBy("start_time", *ties)
    return children.withColumn("fold_no", (F.row_number().over(order) - 1).cast("int"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_id, y, pred_a, pred_b) of rows that two prediction sets share, where the labels agree."""
    left = a.select("row_id", "y", F.col("pred").alias("pred_a"))
    right = b.select("row_id", F.col("y").alias("y_b"), F.col("pred").alias("pred_b"))
    return left.join(right, "row_id").filter("y = y_b").drop("y_b")


def alignment_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each set has alone, both have, and both have with different labels."""
    left, right = a.select("row_id", F.col("y").alias("ya")), b.select("row_id", F.col("y").alias("yb"))
    j = left.join(right, "row_id", "full_outer")
    return j.agg(
        F.count_if(F.col("yb").isNull()).alias("only_a"), F.count_if(F.col("ya").isNull()).alias("only_b"),
        F.count_if(F.col("ya").isNotNull() & F.col("yb").isNotNull()).alias("shared"), F.count_if(F.col("ya") != F.col("yb")).alias("label_mismatch"))


def fold_scores(children: DataFrame, parents: DataFrame, cell: dict[str, object], folds: int, metric: str = "f1_macro", ties: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(parent_run_id, fold_no, metric) of the newest clean sweep of a cell, given by values of columns of the children or else of the
    parents, in fold order.

    An error where no finished sweep with exactly `folds` children that have the metric matches: nothing there can be trusted.
    """
    above = {n: v for n, v in cell.items() if n not in children.columns and n in parents.columns}
    require(children, (*[n for n in cell if n not in above], "parent_run_id", "start_time", metric))
    require(parents, ("run_id", "status", "start_time"))
    matches, up = children, parents
    for name, value in cell.items():
        own = F.col(name).cast("string") == str(value)
        matches, up = (matches, up.filter(own)) if name in above else (matches.filter(own), up)
    found = clean_sweeps(children, up, folds, metric)
    if len(above) < len(cell):
        found = found.join(matches.select("parent_run_id").distinct(), "parent_run_id", "left_semi")
    starts = up.select(F.col("run_id").alias("parent_run_id"), F.col("start_time").alias("_start"))
    newest_ = found.join(starts, "parent_run_id").agg(F.max_by("parent_run_id", F.struct("_start", "parent_run_id")).alias("id")).first()["id"]
    if newest_ is None:
        raise ValueError(f"{'/'.join(map(str, cell.values()))}: no finished sweep with exactly {folds} folds")
    return fold_numbers(matches.filter(F.col("parent_run_id") == newest_), ties).select("parent_run_id", "fold_no", metric)


def encoding(parent_tag: Column, children: Column) -> Column:
    """A sweep's encoding: the parent's tag, where it has one, else what its folds' parameters agree on."""
    return F.coalesce(parent_tag, sweep_encoding(children))
