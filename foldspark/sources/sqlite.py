"""SQLite tables as a data source: ranges of row ids are partitions, columns and filters are left to the database.

    spark.dataSource.register(SQLite)
    spark.read.format("sqlite").option("path", "/shared/meta.db").option("table", "meta").load().filter("is_malware = 1")

Each task opens the file for reading and takes one range of row ids, so a table is scanned in parallel without anyone choosing bounds.
Only the columns of the schema are read: all, or those of the schema that is given to the reader. Filters by =, <, <=, >, >=, IN, NULL and
their opposites go into the query in sessions with spark.sql.python.filterPushdown.enabled (read() sees to it); others stay with Spark. The file has to lie where all
executors can read it. A table WITHOUT ROWID is one partition.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: Row ids of a partition, at least, and how many partitions there are without the option.
RANGE, PARTITIONS = 10_000, 16
BATCH = 10_000


@dataclass
class Rows(InputPartition):
    first: int | None
    last: int | None


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind(declared: str) -> DataType:
    """Spark's type for a declared one, by the database's own rules of affinity."""
    d = declared.upper()
    if "BOOL" in d:
        return BooleanType()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DEC")):
        return DoubleType()
    return BinaryType() if "BLOB" in d or not d else StringType()


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL and its values; None for what the database isn't asked."""
    simple = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if isinstance(f, Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(getattr(f, "attribute", ())) != 1:
        return None
    c = quoted(f.attribute[0])
    if isinstance(f, IsNull):
        return f"{c} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{c} IS NOT NULL", []
    plain = lambda v: isinstance(v, (int, float, str, bool))
    if type(f) in simple and plain(f.value):
        return f"{c} {simple[type(f)]} ?", [f.value]
    if isinstance(f, In) and all(map(plain, f.value)):
        return f"{c} IN ({', '.join('?' * len(f.value))})", list(f.value)
    return None


class SQLite(DataSource):
    """Options: path, table, partitions, filters (true where the session hands them over)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with closing(opened(self.options["path"])) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(name, kind(declared)) for _, name, declared, *_ in found])

    def reader(self, schema: StructType) -> SQLiteReader:
        of = FilteringReader if self.options.get("filters") == "true" else SQLiteReader
        return of(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", PARTITIONS)))


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://').removeprefix('file:')}?mode=ro", uri=True)


class SQLiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, wanted: int):
        self.path, self.table, self.schema, self.wanted = path, table, schema, wanted
        self.where: list[tuple[str, list]] = []

    def partitions(self) -> list[Rows]:
        with closing(opened(self.path)) as db:
            try:
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
                return [Rows(None, None)]
        if first is None:
            return [Rows(0, 0)]
        step = max(RANGE, -(-(last - first + 1) // self.wanted))
        return [Rows(lo, min(lo + step - 1, last)) for lo in range(first, last + 1, step)]

    def query(self, partition: Rows) -> tuple[str, list]:
        columns = ", ".join(quoted(c) for c in self.schema.names) or "1"
        where = ([("rowid BETWEEN ? AND ?", [partition.first, partition.last])] if partition.first is not None else []) + self.where
        tail = f" WHERE {' AND '.join(c for c, _ in where)}" if where else ""
        return f"SELECT {columns} FROM {quoted(self.table)}{tail}", [v for _, values in where for v in values]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        fit = lambda t: bool if pa.types.is_boolean(t) else float if pa.types.is_floating(t) else int if pa.types.is_integer(t) else None
        casts = [fit(f.type) for f in want]
        with closing(opened(self.path)) as db:
            rows = db.execute(*self.query(partition))
            while some := rows.fetchmany(BATCH):
                columns = zip(*some, strict=True)
                arrays = [pa.array([None if v is None else cast(v) for v in c] if cast else list(c), f.type) for c, f, cast in zip(columns, want, casts, strict=True)]
                yield pa.record_batch(arrays, schema=want)


class FilteringReader(SQLiteReader):
    """For sessions that hand filters to sources; in others, Spark refuses a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = condition(f)
            if known:
                self.where.append(known)
            else:
                yield f


def read(spark: SparkSession, path: str, table: str, columns: str | StructType | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """A table, or those of its columns that `columns` names as a schema."""
    spark.dataSource.register(SQLite)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("sqlite").options(path=path, table=table, partitions=partitions, filters=filters)
    return (reader.schema(columns) if columns else reader).load()
