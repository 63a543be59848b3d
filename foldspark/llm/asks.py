"""Chunks of documents that ask parts of a key space, and get answers.

A chunk is some megabytes of consecutive rows of the scan. It sends its distinct keys, sorted, to the parts that own them by
their first bits; a part sees the keys of all chunks, and its answers come back to the chunk, in the order of its keys. Keys are
sent as differences, so a key takes about as many bits as the key space is larger than the chunk, and a part's size follows
from the number of parts, whatever the keys are.

Rows of a chunk travel as one compressed blob. A chunk is named after its place in the scan and its contents, and scanned once
for the blob and once for each question, so docs has to be read in a stable order, as files are; steady() sees to it that files
are split alike by all jobs, though executors come and go. A chunk whose answers aren't all there, as it was scanned in another
order, ends the job; it never gives a wrong result.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from foldspark.llm import text as X

CHUNK = 3 << 20
PLANNED = "spark.sql.leafNodeDefaultParallelism"
_CODEC = "zstd"


def slices(b: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some megabytes of text each."""
    text = b.column(b.schema.get_field_index("text"))
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(float))) if len(b) else []
    lo = 0
    while lo < len(b):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most)))
        yield b.slice(lo, hi - lo)
        lo = hi


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of rows in order, of about `size` bytes of text each."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        for b in slices(batch, size):
            n = pc.sum(pc.binary_length(b.column(b.schema.get_field_index("text")))).as_py() or 0
            if held and have + n > size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, have = [], 0
            held.append(b)
            have += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _name(t: pa.Table, place: int) -> int:
    raw, offsets = X.arrow_bytes(t.column("text"))
    h = xxhash.xxh3_64(f"{TaskContext.get().partitionId()}:{place}")
    h.update(np.ascontiguousarray(offsets))
    h.update(np.ascontiguousarray(raw))
    return h.intdigest() >> 1


def steady(spark: SparkSession) -> None:
    """Fixes, for the session, how many cores a scan is planned for: otherwise small files are split by the number of executors
    at hand, and two jobs might split them differently."""
    if spark.conf.get(PLANNED, None) is None:
        spark.conf.set(PLANNED, spark.sparkContext.defaultParallelism)


def each_chunk(docs: DataFrame, f: Callable[[int, pa.Table], pa.Table], ddl: str, size: int = CHUNK) -> DataFrame:
    """f over all chunks of docs, with their names."""
    steady(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(chunks(batches, size)):
            yield from f(_name(t, k), t).to_batches()
            tidy()

    return docs.mapInArrow(run, ddl)


def tidy() -> None:
    """Gives freed memory back, as allocators keep what large arrays leave behind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """f for groups, which gives memory back after each."""

    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        tidy()
        return out

    return (lambda t: run(t)) if f.__code__.co_argcount == 1 else (lambda left, right: run(left, right))


def pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def blobs(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, blob): a row for each chunk."""
    return each_chunk(docs, lambda name, t: pa.table({"chunk": pa.array([name]), "blob": pa.array([pack(t)], pa.binary())}), "chunk long, blob binary", size)


def numbers(x: np.ndarray) -> bytes:
    """Whole numbers, most of them small, in few bytes: planes of their bytes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(4, "little") + x.dtype.char.encode() + pa.compress(planes, _CODEC, asbytes=True)


def unnumbers(data: bytes) -> np.ndarray:
    n, kind = int.from_bytes(data[:4], "little"), np.dtype(data[4:5].decode())
    planes = pa.decompress(data[5:], n * kind.itemsize, _CODEC, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def rising(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, as differences."""
    return numbers(np.diff(x, prepend=x.dtype.type(0)))


def unrising(data: bytes) -> np.ndarray:
    return np.cumsum(unnumbers(data), dtype=np.uint64)


def part_bits(keys: int, most: int) -> int:
    """How many first bits of a key name its part, for parts of `most` keys on average, at most."""
    return max(0, (keys // most).bit_length())


def runs(keys: np.ndarray, shift: int, parts: int) -> np.ndarray:
    """Where each part's keys begin among sorted ones, and the end."""
    return np.searchsorted(keys >> np.uint64(shift), np.arange(parts + 1, dtype=np.uint64)) if shift < 64 else np.array([0, len(keys)])


def whole(answers: pa.Table, parts: int) -> pa.Table:
    """A chunk's answers by part, once it is sure that all are there."""
    answers = answers.sort_by("part")
    if answers.column("part").to_numpy().tolist() != list(range(parts)):
        raise RuntimeError("a chunk's answers aren't whole: the documents weren't read twice in the same order; write them to files first")
    return answers


def joined(values: list[bytes], read: Callable[[bytes], np.ndarray] = unnumbers) -> np.ndarray:
    return np.concatenate([read(v) for v in values])
