"""A store of runs as a data source with commits: readers see whole writes or nothing of them.

    spark.dataSource.register(RunStore)
    runs.write.format("runs").mode("append").save(path)
    spark.read.format("runs").load(path)

Tasks write Parquet files under names of their own and give the driver their names; the driver commits a write by one small file that
lists them, put in place by a rename. A task or a driver that is lost leaves files that no commit names: they are never read. Appends
don't touch each other's files, so two at once both appear. A store is a folder that driver and executors share.

A run is a row for each state it was in (RUNNING, then FINISHED or FAILED); `current` keeps the last of each run. `Run` is a run's life
in a `with` block, which ends it as FAILED where an error leaves the block.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from types import TracebackType

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "run_id string, parent_run_id string, status string, start_time timestamp, updated timestamp, params map<string,string>, metrics map<string,double>, tags map<string,string>"
RUNNING, FINISHED, FAILED = "RUNNING", "FINISHED", "FAILED"
#: Bytes of files that a task reads, about.
SPLIT = 64 << 20


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))


@dataclass
class Wrote(WriterCommitMessage):
    names: list[str]
    rows: int


@dataclass
class Files(InputPartition):
    names: list[str]


class RunStore(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RunReader:
        return RunReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if overwrite:
            raise ValueError("a store of runs is appended to; its history isn't replaced")
        missing = {"run_id", "status", "updated"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return RunWriter(self.options["path"], schema)


class RunWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, where = place(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for b in iterator:
            if out is None:
                fs.create_dir(posixpath.join(where, "files"), recursive=True)
                out = pq.ParquetWriter(posixpath.join(where, "files", name), b.schema, filesystem=fs)
            out.write_batch(b)
            rows += b.num_rows
        if out is not None:
            out.close()
        return Wrote([name] if out is not None else [], rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, where = place(self.path)
        done = [m for m in messages if m is not None]
        folder, name = posixpath.join(where, "commits"), uuid.uuid4().hex
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(posixpath.join(folder, f"_{name}")) as f:
            f.write(json.dumps({"files": [n for m in done for n in m.names], "rows": sum(m.rows for m in done)}).encode())
        fs.move(posixpath.join(folder, f"_{name}"), posixpath.join(folder, f"{name}.json"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, where = place(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(posixpath.join(where, "files", name))


class RunReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Files]:
        """Files of committed writes, in groups of about SPLIT bytes."""
        fs, where = place(self.path)
        names: list[str] = []
        for info in sorted(listed(fs, posixpath.join(where, "commits")), key=lambda x: x.path):
            if info.base_name.endswith(".json"):
                with fs.open_input_stream(info.path) as f:
                    names += json.loads(f.read())["files"]
        sizes = {x.base_name: x.size for x in listed(fs, posixpath.join(where, "files"))} if names else {}
        groups, held = [], 0
        for n in names:
            if not groups or held + sizes[n] > SPLIT:
                groups.append(Files([]))
                held = 0
            groups[-1].names.append(n)
            held += sizes[n]
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, where = place(self.path)
        want = to_arrow_schema(self.schema)
        for name in partition.names:
            with fs.open_input_file(posixpath.join(where, "files", name)) as f:
                for b in pq.ParquetFile(f).iter_batches():
                    yield pa.record_batch([b.column(c.name).cast(c.type) if c.name in b.schema.names else pa.nulls(b.num_rows, c.type) for c in want], schema=want)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All states of all runs of committed writes."""
    spark.dataSource.register(RunStore)
    return spark.read.format("runs").load(path)


def append(runs: DataFrame, path: str) -> None:
    runs.sparkSession.dataSource.register(RunStore)
    runs.write.format("runs").mode("append").save(path)


def current(states: DataFrame) -> DataFrame:
    """The last state of each run; of equal times a final one, and FAILED before FINISHED."""
    rank = F.when(F.col("status") == RUNNING, 0).when(F.col("status") == FINISHED, 1).otherwise(2)
    row = F.struct(*[c for c in states.columns if c != "run_id"])
    return states.groupBy("run_id").agg(F.max_by(row, F.struct("updated", rank)).alias("r")).select("run_id", "r.*")


@dataclass
class Run:
    """A run: `with Run(spark, path, {"model": "x"}) as r: r.log({"f1": 0.5})`. The state RUNNING is committed on entry, FINISHED or
    FAILED on exit; a run whose process was lost stays RUNNING. parent: a Run, or a run's id."""

    spark: SparkSession
    path: str
    params: dict[str, object] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    parent: Run | str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    metrics: dict[str, float] = field(default_factory=dict)

    def __enter__(self) -> Run:
        self.start = datetime.now(timezone.utc)
        self._state(RUNNING)
        return self

    def log(self, metrics: dict[str, float]) -> None:
        self.metrics.update({k: float(v) for k, v in metrics.items()})

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if error is not None:
            self.tags = self.tags | {"error": f"{kind.__name__}: {error}"[:500]}
        self._state(FINISHED if error is None else FAILED)

    def _state(self, status: str) -> None:
        parent = self.parent.run_id if isinstance(self.parent, Run) else self.parent
        row = (self.run_id, parent, status, self.start, datetime.now(timezone.utc), {k: str(v) for k, v in self.params.items()}, dict(self.metrics), dict(self.tags))
        append(self.spark.createDataFrame([row], SCHEMA).coalesce(1), self.path)


def log_sweep(folds: DataFrame, path: str, params: dict[str, object], tags: dict[str, str] | None = None) -> str:
    """Appends a finished sweep and a run of each fold in one commit, from (fold, metrics map); gives the sweep's id."""
    sweep, now = uuid.uuid4().hex, F.current_timestamp()
    constant = lambda d: F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    each = folds.select(
        F.concat(F.lit(f"{sweep}-"), F.col("fold").cast("string")).alias("run_id"), F.lit(sweep).alias("parent_run_id"), F.lit(FINISHED).alias("status"), now.alias("start_time"), now.alias("updated"),
        F.map_concat(constant(params), F.create_map(F.lit("fold"), F.col("fold").cast("string"))).alias("params"), F.col("metrics"), constant(tags or {}).alias("tags"))
    means = folds.select(F.explode("metrics").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics"))
    parent = means.select(
        F.lit(sweep).alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"), F.lit(FINISHED).alias("status"), now.alias("start_time"), now.alias("updated"),
        constant(params).alias("params"), "metrics", constant(tags or {}).alias("tags"))
    append(parent.unionByName(each), path)
    return sweep
