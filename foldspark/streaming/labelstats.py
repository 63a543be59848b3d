"""Label statistics of a stream: batches are summed up one by one, and parts add up to the statistics of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foldspark.operators import labelstats


def write_parts(stream: DataFrame, tags: list[str], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes the statistics of each micro-batch to its own folder; a repeated batch replaces its part."""

    def part(df: DataFrame, batch: int) -> None:
        labelstats.stats(df, tags).write.mode("overwrite").parquet(f"{path}/part={batch}")

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_total(spark, path: str) -> DataFrame:
    return labelstats.merge(spark.read.parquet(path))
