"""Distribution states of a stream: each batch's states are stored, and merged when they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.operators import sketches


def start(stream: DataFrame, by: list[str], column: str, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes a batch's states to a folder of its own, which a batch that is run again replaces."""

    def store(batch: DataFrame, number: int) -> None:
        sketches.states(batch, by, column).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """States of all that was read so far."""
    return sketches.merge(spark.read.parquet(path).drop("batch"), by).select(*by, *[F.col(c) for c in ("n", "s1", "s2", "least", "most", "sketch")])
