"""Session and table helpers of the document operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark.sources.shared import shared_dir

#: Rows of a broadcast table of hot keys, at most.
HOT = 1024
WORD = r"[^\x20\x09-\x0D]+"


def table_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_scope: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Lets go, at its end, of all tables that were written or kept within it, in this thread: what comes from them has to be
    written by then. Tables made outside of any scope stay, as a result that isn't evaluated yet may need them."""
    own: list[DataFrame] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for df in own:
            discard(df)


def _hold(df: DataFrame) -> DataFrame:
    if (own := _scope.get()) is not None:
        own.append(df)
    return df


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return _hold(out)


def kept(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks for several uses; what a lost executor held is computed again from its lineage."""
    return _hold(df.persist(StorageLevel.DISK_ONLY))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever the shared folder is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Lets go of a table of written() or kept(), which nothing may read any more."""
    if path := getattr(df, "_written_at", None):
        delete(df.sparkSession, path)
    else:
        df.unpersist()
    if own := _scope.get():
        own[:] = [x for x in own if x is not df]


def small(df: DataFrame) -> DataFrame:
    """df, the result of a shuffle with little to do behind it, in an eighth of its partitions: fewer and larger files."""
    return df.coalesce(max(1, partitions(df.sparkSession) // 8))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def integer_ids(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs, or a clear error where its ids aren't integers."""
    if not isinstance(docs.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be an integer column, not {docs.schema[column].dataType.simpleString()}")
    return docs


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def word_count(text) -> F.col:
    """Number of words of a text column (null: 0)."""
    return F.size(word_array(text)).cast("long")


def word_array(text) -> F.col:
    """Words of a text column (null: none)."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", " " * 5)
    return F.array_remove(F.split(flat, " ", -1), "")


def join_hot(left: DataFrame, right: DataFrame, on: str, size: str) -> DataFrame:
    """left joined with right, whose keys are unique; `size` there says how many rows of left have the key.

    Keys with a share of 1 in HOT of left's rows or more, HOT of them at most, are broadcast, so that none gathers its rows in one task.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(2, total / HOT)
    many = F.broadcast(right.filter(hot).withColumnRenamed(on, "_hot"))
    few = right.filter(~hot)
    joined = left.join(many, left[on] == many["_hot"]).drop("_hot")
    rest = left.join(many.select("_hot"), left[on] == many["_hot"], "left_anti").join(few, on)
    return joined.select(*rest.columns).union(rest)
