"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than CHUNK code points is cut into chunks that overlap, a row each, spread over all tasks. Each chunk is
pre-tokenised by itself from its first code point on, wherever that falls. It starts inside a pre-token, as a rule, and soon falls
into step with its predecessor, as the pattern only looks ahead from where it stands. A chunk's piece begins at the first of
its own boundaries in the second half of the overlap, and its predecessor, whose row holds the overlap too, finds that place as
well, ends its piece there, and checks that it is one of its own boundaries. So pieces fit together and each is encoded
where it was pre-tokenised. A text with a chunk that is out of step to the end of an overlap is encoded as a whole.
Decoding joins the raw bytes of the ids.

Cases: a null text is an empty text with no ids; repeated rows are encoded each by itself (chunks of equal texts once); an empty
table gives no rows; further columns are ignored by `encode` and carried by `encoded_docs`, whatever their names. Texts are
encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
OVERLAP = 1 << 10
#: Code points before the end of a cut text where its boundaries may differ from those of the whole text.
MARGIN = 16
_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tokenizer of a file of ranks, one for each worker process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def boundaries(text: str, pattern: str, start: int, end: int) -> list[int]:
    """Ends of the pre-tokens from start on, up to the first at or after end."""
    import regex

    out = []
    for m in regex.compile(pattern).finditer(text, start):
        out.append(m.end())
        if m.end() >= end:
            break
    return out


def starts(n: int, chunk: int) -> list[int]:
    """Where the chunks of a text of n code points begin; the last has up to twice the size of the others."""
    return list(range(0, max(1, n // chunk) * chunk, chunk))


def first_cut(overlap: str, pattern: str) -> int | None:
    """Where the piece of a chunk begins that begins with this overlap: a boundary after a character other than white space, as
    the pattern looks at what comes after white space."""
    n = len(overlap)
    return next((b for b in boundaries(overlap, pattern, 0, n) if n // 2 <= b < n - MARGIN and not overlap[b - 1].isspace()), None)


def piece(text: str, first: bool, last: bool, pattern: str, chunk: int, overlap: int) -> tuple[int, int, bool]:
    """Start and end of a chunk's piece in its row's text, and whether its boundaries are in step with the next chunk's."""
    start = 0 if first else first_cut(text[:overlap], pattern)
    if start is None:
        return 0, 0, False
    if last:
        return start, len(text), True
    end = first_cut(text[chunk : chunk + overlap], pattern)
    if end is None:
        return 0, 0, False
    end += chunk
    return start, end, end in set(boundaries(text, pattern, start, end)[-1:])


def encode_text(text: str | None, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text, chunk by chunk."""
    text = text or ""
    enc, out = encoding(path, pattern), []
    at = starts(len(text), chunk)
    for s in at:
        row = text[s:] if s == at[-1] else text[s : s + chunk + overlap]
        a, b, ok = piece(row, s == 0, s == at[-1], pattern, chunk, overlap)
        if not ok:
            return enc.encode_ordinary(text)
        out += enc.encode_ordinary(row[a:b])
    return out


def _lists(ids: list[list[int]]) -> pa.ListArray:
    at = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=at[1:])
    return pa.ListArray.from_arrays(at, np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32))


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            for lo in range(0, len(b), 512):  # so that ids of a large batch aren't all in memory
                ids = [enc.encode_ordinary(t.as_py() or "") for t in text.slice(lo, 512)]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, 512).columns, _lists(ids)], [*b.schema.names, "bpe_ids"])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                at = starts(len(text), chunk)
                rows = [text[s:] if s == at[-1] else text[s : s + chunk + overlap] for s in at]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at)), pa.array(range(len(at)), pa.int32()), pa.array([len(at)] * len(at), pa.int32()), pa.array(rows, pa.string())], ["key", "k", "n", "text"])

    return run


def _encode_pieces(path: str, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.slice(lo, 128)
                ids, good = [], []
                for k, n, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                    text = text.as_py()
                    start, end, ok = piece(text, k == 0, k == n - 1, pattern, chunk, overlap)
                    ids.append(enc.encode_ordinary(text[start:end]) if ok else [])
                    good.append(ok)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(good), _lists(ids)], ["key", "k", "ok", "ids"])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def long_ids(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ok, ids) of (key, text), texts of several chunks: chunks are encoded in parallel, and equal ones once."""
    rows = texts.mapInArrow(_cut(chunk, overlap), "key string, k int, n int, text string")
    rows = rows.groupBy("key", "k").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    pieces = rows.mapInArrow(_encode_pieces(path, pattern, chunk, overlap), "key string, k int, ok boolean, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return pieces.groupBy("key").agg(F.every("ok").alias("ok"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def _whole(path: str, pattern: str):
    """Ids of texts whose chunks were in step; others are encoded as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                ids = part.column(3)
                if not pc.all(part.column(2)).as_py():
                    ids = _lists([x.as_py() if ok else enc.encode_ordinary(t.as_py()) for t, ok, x in zip(part.column(1), part.column(2).to_pylist(), ids, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc", "bpe_ids"])

    return run


def _encoded(docs: DataFrame, columns: list[str], path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    packed = docs.select(F.struct(*[F.col(c) for c in columns]).alias("doc"), "text")
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = packed.filter(~is_long).mapInArrow(_encoder(path, pattern), _ddl(packed) + ", bpe_ids array<int>").select("doc", "bpe_ids")
    longs = packed.filter(is_long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    ids = long_ids(longs.select("key", "text"), path, pattern, chunk, overlap)
    both = longs.join(ids.hint("merge"), "key").select("doc", "text", "ok", "ids")
    both = both.mapInArrow(_whole(path, pattern), _ddl(packed.select("doc")) + ", bpe_ids array<int>")
    return short.union(both).select("doc.*", "bpe_ids")


def encoded_docs(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with bpe_ids, an array of ids of the text, in place of a column of that name."""
    docs = docs.drop("bpe_ids")
    return _encoded(docs, docs.columns, path, pattern, chunk, overlap)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and bpe_ids."""
    return _encoded(docs, ["doc_id"], path, pattern, chunk, overlap)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with bpe_bytes: the bytes of its bpe_ids, and bpe_ids_le: the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            at = b.schema.get_field_index("bpe_ids")
            raw, packed = [], []
            for x in b.column(at):
                ids = [] if x.values is None else x.values.to_numpy(zero_copy_only=False)
                packed.append(np.asarray(ids, "<u4").tobytes())
                raw.append(b"".join(enc.decode_tokens_bytes([int(i) for i in ids])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(raw, pa.binary()), pa.array(packed, pa.binary())], [*b.schema.names, "bpe_bytes", "bpe_ids_le"])

    return encoded.mapInArrow(run, _ddl(encoded) + ", bpe_bytes binary, bpe_ids_le binary")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes."""
    d = decode(encode(docs, path, pattern, chunk, overlap), path, pattern)
    return d.select(
        "doc_id", F.size("bpe_ids").cast("long").alias("n_tokens"), F.sha2("bpe_ids_le", 256).alias("ids_sha256"),
        F.sha2("bpe_bytes", 256).alias("decoded_sha256"))
