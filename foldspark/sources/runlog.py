"""A store of hierarchical runs as an appended Parquet table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators.metrics import confusion

SCHEMA = "run_id string, parent_run_id string, status string, start_time timestamp, params map<string,string>, metrics map<string,double>, tags map<string,string>"


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """(model, fold, accuracy, f1_macro) of (model, fold, y, y_pred), from confusion counts."""
    keys = ["model", "fold"]
    c = confusion(predictions, "y", "y_pred", tuple(keys))
    true = c.groupBy(*keys, F.col("y").alias("l")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    guess = c.groupBy(*keys, F.col("p").alias("l")).agg(F.sum("n").alias("g"))
    j = true.join(guess, [*keys, "l"], "full_outer").na.fill(0, ["t", "tp", "g"])
    return j.groupBy(*keys).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("g"))).alias("f1_macro"))


def log_sweep(predictions: DataFrame, path: str, dataset: str, task: str, n_components: int, tags: dict[str, str]) -> str:
    """Appends a finished sweep and a run for each fold; gives the sweep's id."""
    sweep = uuid.uuid4().hex
    params = F.create_map(F.lit("dataset"), F.lit(dataset), F.lit("task"), F.lit(task), F.lit("n_components"), F.lit(str(n_components)), F.lit("model"), F.col("model"))
    tag_map = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    m = fold_metrics(predictions)
    runs = m.select(
        F.concat(F.lit(f"{sweep}-"), F.col("fold").cast("string")).alias("run_id"), F.lit(sweep).alias("parent_run_id"), F.lit("FINISHED").alias("status"), F.current_timestamp().alias("start_time"),
        params.alias("params"), F.create_map(F.lit("accuracy"), "accuracy", F.lit("f1_macro"), "f1_macro").alias("metrics"), tag_map.alias("tags"))
    parent = m.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.avg("f1_macro").alias("f1_macro")).select(
        F.lit(sweep).alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"), F.lit("FINISHED").alias("status"), F.current_timestamp().alias("start_time"),
        params.alias("params"), F.create_map(F.lit("accuracy"), "accuracy", F.lit("f1_macro"), "f1_macro").alias("metrics"), tag_map.alias("tags"))
    parent.unionByName(runs).write.mode("append").parquet(path)
    return sweep


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def export(runs: DataFrame, condition: str | None = None) -> DataFrame:
    """Runs as one flat table, sorted by start: parameters and metrics as columns params_* and metrics_* of all keys that occur, the
    parent's id, no other tags. condition: SQL on the flat columns. An error where no run is left."""
    names = runs.agg(*[F.array_sort(F.flatten(F.collect_set(F.map_keys(c)))).alias(c) for c in ("params", "metrics")]).first()  # keys, not rows
    flat = runs.select("run_id", "parent_run_id", "status", "start_time", *[F.col(c)[k].alias(f"{c}_{k}") for c in ("params", "metrics") for k in sorted(set(names[c] or []))])
    flat = flat.filter(condition) if condition else flat
    if flat.isEmpty():
        raise ValueError("no runs found" + (f" where {condition}" if condition else ""))
    return flat.orderBy("start_time", "run_id")
