"""WARC archives in seekable Zstandard bundles: records in independent frames, a seek table at the end, an index of record places.

A bundle is a file of Zstandard frames, each with some whole WARC/1.1 records (response, or revisit of an equal payload), and a
skippable frame at its end with the sizes of all frames, as the public seekable format has it; any Zstandard tool reads a bundle
from start to end. The index has a row for each record: its bundle, frame, place within the frame's decompressed bytes, and
length; so a record costs one read of one frame. Tasks write bundles under names of their own and the index is written by
Spark's committer: bundles of lost or repeated attempts aren't in the index, and readers ignore them.

Which record is the response is settled before anything is written: payloads meet by their SHA-1 in a shuffle, where the least
page_id of a digest is an aggregate and a hot digest is split like any skewed join. A revisit carries no payload.

Cases: a null html is an empty payload; a null url has no target; a null page_id is larger than any other, and rows with equal
page_id and payload are alike (responses if theirs is the least); payloads below `least` bytes are always responses; a record
longer than a frame has a frame of its own; an empty table makes an empty index and no bundles; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.common import partitions, table_path

#: Bytes of records in a frame, at least (a bundle's last frame may have fewer), and of frames in a bundle.
FRAME = 1 << 18
BUNDLE = 1 << 26
LEVEL = 3
#: Payloads of fewer bytes aren't looked up for equal ones.
LEAST = 0
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the seekable format, and of WARC/1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    page: object
    url: str | None
    kind: str
    refers_to: object
    digest: str
    size: int
    payload: bytes | None


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{json.dumps(page)}:{digest}'.encode()).digest())}>"


def record_bytes(r: Record) -> bytes:
    """A WARC record. The header Page holds what WARC has no field for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.size}\r\n\r\n".encode()
    block = http + (r.payload if r.kind == "response" else b"")
    head = [("WARC-Type", r.kind), ("WARC-Record-ID", _id(r.page, r.digest)), ("WARC-Date", DATE)]
    if r.url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in r.url)))
    head.append(("WARC-Payload-Digest", f"sha1:{r.digest}"))
    if r.kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(r.refers_to, r.digest))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)), ("Page", json.dumps([r.page, r.url, r.refers_to]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[Record]:
    """The records of a frame. A response's digest and size are those of its payload as read; a false digest is an error."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = bytes(view[at:end]).decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        start, at = end + 4, end + 4 + int(head["Content-Length"]) + 4
        page, url, refers_to = json.loads(head["Page"])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        body = data.index(b"\r\n\r\n", start) + 4
        if head["WARC-Type"] == "revisit":
            size = next(int(x[15:]) for x in bytes(view[start:body]).decode().split("\r\n") if x.startswith("Content-Length:"))
            yield Record(page, url, "revisit", refers_to, digest, size, None)
        else:
            payload = bytes(view[body : at - 4])
            if (read := base32(hashlib.sha1(payload).digest())) != digest:
                raise ValueError(f"the payload of page {page} has the digest {read}, not {digest}")
            yield Record(page, url, "response", None, read, len(payload), payload)


class Bundle:
    """Writes one bundle."""

    def __init__(self, path: str, frame: int = FRAME):
        self.frame = frame
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        fs, where = pafs.FileSystem.from_uri(path)
        fs.create_dir(where, recursive=True)
        self.out = fs.open_output_stream(posixpath.join(where, self.name), compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.raw = self.written = 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, place in it and length of the record."""
        place = (len(self.sizes), self.raw, len(record))
        self.held.append(record)
        self.raw += len(record)
        if self.raw >= self.frame:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.pack.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.raw))
            self.written += len(frame)
            self.held, self.raw = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Frames:
    """Reads frames of one bundle."""

    def __init__(self, path: str):
        fs, where = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(where)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * width, end - 9 - n * width)
        self.sizes = [struct.unpack_from("<II", table, k * width) for k in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpack = zstandard.ZstdDecompressor()

    def __getitem__(self, k: int) -> bytes:
        return self.unpack.decompress(self.file.read_at(self.sizes[k][0], self.starts[k]), max_output_size=self.sizes[k][1])

    def close(self) -> None:
        self.file.close()


def labelled(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the least page_id with an equal payload, null for short ones."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    firsts = keyed.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    return keyed.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", "first")


def bundle(pages: DataFrame, path: str, least: int = LEAST, frame: int = FRAME, size: int = BUNDLE) -> DataFrame:
    """Writes the pages as WARC bundles below `path`; the index (page_id, refers_to, bundle, frame, place, length), from its table."""
    kind = pages.schema["page_id"].dataType.simpleString()
    arrow = pa.schema([("page_id", _arrow(kind)), ("refers_to", _arrow(kind)), ("bundle", pa.string()), ("frame", pa.int32()), ("place", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            rows = []
            for page, url, payload, digest, first in zip(*(b.column(k) for k in range(5)), strict=True):
                page, first = page.as_py(), first.as_py()
                again = first is not None and page != first
                data = payload.as_py()
                r = Record(page, url.as_py(), "revisit" if again else "response", first if again else None, base32(bytes.fromhex(digest.as_py())), len(data), data)
                out = out or Bundle(f"{path}/bundles", frame)
                rows.append((page, r.refers_to, out.name, *out.add(record_bytes(r))))
                if out.written >= size:
                    out.close()
                    out = None
            yield pa.record_batch([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(6)], schema=arrow)
        if out:
            out.close()

    ddl = f"page_id {kind}, refers_to {kind}, bundle string, frame int, place long, length long"
    labelled(pages, least).mapInArrow(write, ddl).write.parquet(f"{path}/index")
    return index(pages.sparkSession, path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _arrow(kind: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in kinds:
        raise TypeError(f"page_id must be a column of integers or strings, not {kind}")
    return kinds[kind]


def _read(index: DataFrame) -> tuple[str, pa.Schema]:
    kind = index.schema["page_id"].dataType.simpleString()
    names = [("page_id", kind), ("url", "string"), ("record_type", "string"), ("refers_to", kind), ("payload_digest", "string"), ("payload_bytes", "bigint"), ("payload", "binary")]
    arrow = pa.schema([(n, _arrow(k) if k != "binary" else pa.binary()) for n, k in names])
    return ", ".join(f"{n} {k}" for n, k in names), arrow


def _batch(rows: list[Record], schema: pa.Schema, payload: bool) -> pa.RecordBatch:
    columns = [[r[k] for r in rows] for k in range(7)]
    if not payload:
        columns[6] = [None] * len(rows)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the index's bundles, frame by frame: (page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).

    Digest and bytes of a response are taken from the payload as read, those of a revisit from its headers; a revisit's payload is
    null, as are all without `payload`. Bundles are spread over as many tasks as there are shuffle partitions.
    """
    of = index(spark, path)
    ddl, schema = _read(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                frames = Frames(f"{path}/bundles/{name}")
                for k in range(len(frames.sizes)):
                    yield _batch(list(records(frames[k])), schema, payload)
                frames.close()

    return of.select("bundle").distinct().repartition(partitions(spark)).mapInArrow(run, ddl)


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records of ids (page_id), each with its payload, a revisit with that of its response; only frames that hold them are read."""
    of = index(spark, path)
    ddl, schema = _read(of)
    found = of.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    places = of.filter("refers_to IS NULL").select(F.col("page_id").alias("response"), F.struct("bundle", "frame", "place", "length").alias("there")).dropDuplicates(["response"])
    found = found.join(places, F.col("refers_to") == F.col("response"), "left")
    at = found.select("bundle", "frame", "place", "length", "there").sort("bundle", "frame", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Frames] = {}
        held: dict[str, tuple[int, bytes]] = {}

        def one(name: str, frame: int, place: int, length: int) -> Record:
            if name not in opened:
                for f in opened.values():
                    f.close()
                opened.clear()
                held.clear()
                opened[name] = Frames(f"{path}/bundles/{name}")
            if held.get(name, (-1,))[0] != frame:
                held[name] = frame, opened[name][frame]
            return next(records(held[name][1][place : place + length]))

        for b in batches:
            rows = []
            for x in b.to_pylist():
                r = one(x["bundle"], x["frame"], x["place"], x["length"])
                rows.append(r if x["there"] is None else r._replace(payload=one(*x["there"].values()).payload))
            yield _batch(rows, schema, True)

    return at.mapInArrow(run, ddl)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    path = path or table_path(pages.sparkSession, "warc")
    bundle(pages, path)
    return read(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
