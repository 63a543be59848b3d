"""Late materialisation of wide tables: rows are picked by narrow columns, and the wide ones are read only where a picked row lies.

A Parquet table of thousands of columns is scanned for its keys alone, each with its file and its place in it (Spark's hidden
_metadata columns). Picked places go, sorted, to tasks of a range of a file's rows each; a task reads the row groups that hold some of
its places, a batch of columns at a time, and takes the rows from them. What is read follows the selection: a selection of a hundredth
of the rows in clustered files reads about that share, where a join with the wide table reads all of it.

Places in the whole table (0, 1, 2, ... through its files by name) come from the files' row counts, without a sort.

Cases: no picked rows give an empty table; a key that isn't there picks nothing; keys may repeat on either side (a row is taken once);
columns may be nested; files have to lie where pyarrow can open them (local or shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a file that one task looks after, columns that it reads at once.
SPAN, COLUMNS = 1 << 20, 256


def places(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of all rows, with _file and _row: a row's file and its place there. No other column is read."""
    meta = F.col("_metadata")
    return spark.read.parquet(path).select(*columns, meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))


def positions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of all rows with `position`, their place in the whole table, its files taken by name."""
    rows = places(spark, path, columns)
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # a row a file
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").select(*columns, (F.col("_start") + F.col("_row")).alias("position"))


def take(file: pq.ParquetFile, rows: np.ndarray, columns: list[str], batch: int = COLUMNS) -> tuple[pa.Table, int]:
    """The given rows (sorted) of a file, and how many compressed bytes were read for them."""
    meta = file.metadata
    ends = np.cumsum([meta.row_group(k).num_rows for k in range(meta.num_row_groups)])
    group = np.searchsorted(ends, rows, "right")
    top = {c: c.split(".")[0] for c in columns}
    read, parts = 0, []
    for k in np.unique(group):
        of = meta.row_group(int(k))
        read += sum(of.column(i).total_compressed_size for i in range(of.num_columns) if of.column(i).path_in_schema.split(".")[0] in top)
        local = pa.array(rows[group == k] - (ends[k - 1] if k else 0))
        pieces = [file.read_row_group(int(k), columns=columns[lo : lo + batch]).take(local) for lo in range(0, len(columns), batch)]
        whole = pieces[0]
        for p in pieces[1:]:
            for name in p.column_names:
                whole = whole.append_column(p.schema.field(name), p.column(name))
        parts.append(whole)
    return pa.concat_tables(parts), read


def gather(spark: SparkSession, path: str, keys: DataFrame, key: str, columns: list[str] | None = None, count: bool = False, span: int = SPAN) -> DataFrame:
    """The rows of a wide table whose key is among those of `keys`, with all its columns or some.

    count: instead, a row (rows, bytes) for each range of a file that holds picked rows, of what was read there.
    """
    schema = spark.read.parquet(path).schema
    names = columns or schema.names
    wanted = T.StructType([schema[n] for n in names])
    picked = places(spark, path, [key]).join(keys.select(key).distinct(), key, "left_semi").select("_file", "_row")
    spread = picked.withColumn("_part", F.floor(F.col("_row") / span)).repartition("_file", "_part").sortWithinPartitions("_file", "_part", "_row")
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _ranges(batches):
            fs, where = pafs.FileSystem.from_uri(name)
            with fs.open_input_file(where) as f:
                found, read = take(pq.ParquetFile(f), rows, names)
            if count:
                yield pa.record_batch({"rows": [len(rows)], "bytes": [read]})
            else:
                yield from pa.table([found.column(c.name).cast(c.type) for c in arrow], schema=arrow).combine_chunks().to_batches()

    return spread.mapInArrow(run, "rows long, bytes long" if count else wanted)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(file, its rows) of each range, from rows sorted by file, range and place."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        file, part, row = b.column(0).dictionary_encode(), b.column(2).to_numpy(), b.column(1).to_numpy()
        which = file.indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (part[1:] != part[:-1])]))
        for lo, hi in zip(heads, [*heads[1:], len(row)], strict=True):
            name = (file.dictionary[int(which[lo])].as_py(), int(part[lo]))
            if now is not None and name != now:
                yield now[0], np.concatenate(held)
                held = []
            now = name
            held.append(row[lo:hi])
    if now is not None:
        yield now[0], np.concatenate(held)
