"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms (words, A-Z lower-cased) within a band of inverse document frequency, counted over all documents:
log(documents / documents with the term) from LEAST_IDF to MOST_IDF, at any size of the corpus. A term of the band is in a
share of 1 in exp(MOST_IDF) of the documents or more, so the lexicon has at most exp(MOST_IDF) times the mean number of distinct
terms of a document, however many documents there are. Up to LEXICON terms are broadcast; more, as very long documents may
make, are joined: chunks of documents send their distinct terms to parts of the lexicon, and get back which of them it holds.
Besides all of it, SUBSETS random subsets keep a share of its terms, from 1 in 2 ** FIRST_LEVEL down by halves over LEVELS
levels, so that texts of any length have subsets in which they hold a term or two. A document's distinct terms in each give
one signature (terms are sorted, and a sum of their hashes stands for the set), and signatures together are the fingerprint. The likeness of two
fingerprints is the share of equal signatures among those where either has a term. A document without lexicon terms uses all
its words instead; signatures of no terms are zero.

Cases: a null text is an empty text, whose fingerprint is all zero; fingerprints without terms are alike (1) if equal;
repeated rows have equal fingerprints; an empty table gives no rows; further columns are ignored. Ties of doc_id are ordered
by text; a null doc_id comes after all others.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import text as X
from foldspark.llm.common import integer_ids, partitions, text_bytes, written
from foldspark.llm.asks import slices

SUBSETS = 32
FIRST_LEVEL = 4
LEVELS = 8
#: The band: terms in a fifth of the documents to 1 in 2,000, and in two documents at least.
LEAST_IDF, MOST_IDF = math.log(5), math.log(2000)
LEAST = 2
#: Terms that are broadcast, at most.
LEXICON = 1 << 19
FIRST = -(1 << 63)
#: Terms, distinct within a chunk each, that meet in a part of a lexicon that isn't broadcast.
PART_TERMS = 1 << 22


def segment_bits(size: int) -> int:
    """How many bits of a term's hash name its part, for texts of size bytes: a term for some ten bytes."""
    return max(1, (size // 10 // PART_TERMS).bit_length())


def pack(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of data up to each of ends, in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def unpack(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value ends."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(x) for x in values], dtype=np.int64)


def distinct_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, term) pairs."""
    h, d = X.words(raw, offsets, lower=True)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[head], h[head]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, 24 << 20):
            u, n = np.unique(distinct_terms(*X.arrow_bytes(b.column(0)))[1], return_counts=True)
            yield from pa.table({"h": u.view(np.int64), "n": n}).to_batches(max_chunksize=100_000)


def band(docs: DataFrame) -> DataFrame:
    """(h) of all terms of the band."""
    n = docs.count()
    df = docs.select("text").mapInArrow(_frequencies, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least, most = max(LEAST, n * math.exp(-MOST_IDF)), max(LEAST, n * math.exp(-LEAST_IDF))
    return written(df.filter((F.col("n") >= least * (1 - 1e-9)) & (F.col("n") <= most * (1 + 1e-9))).select("h"))


def _words(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.toArrow().column("h").to_numpy().view(X.U64))


def fingerprints(column: pa.Array, words: np.ndarray) -> np.ndarray:
    """A row of 1 + SUBSETS signatures for each text."""
    raw, offsets = X.arrow_bytes(column)
    n = len(column)
    d, h = distinct_terms(raw, offsets)
    known = words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h if len(words) else np.zeros(len(h), bool)
    without = np.bincount(d[known], minlength=n) == 0
    use = known | without[d]
    d, h = d[use], h[use]
    u, inverse = np.unique(h, return_inverse=True)
    at = np.searchsorted(d, np.arange(n + 1))
    out = np.zeros((n, 1 + SUBSETS), np.uint32)
    for s in range(1 + SUBSETS):
        x = X.mix(u + X.U64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        inside = (x >> X.U64(64 - FIRST_LEVEL - s % LEVELS)) == 0 if s else np.ones(len(u), bool)
        total = np.zeros(len(d) + 1, X.U64)
        np.cumsum(np.where(inside, X.mix(x), X.U64(0))[inverse], out=total[1:])
        out[:, s] = (X.mix(total[at[1:]] - total[at[:-1]]) >> X.U64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = (a != 0) | (b != 0)
    n = either.sum(1)
    same = ((a == b) & either).sum(1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, guest) sorted by descending doc_id within buckets of a range each, one shuffle.

    Each bucket ends with guests: copies of the first row of the next bucket (the last has that of the first), so that every row
    but the guests finds the next document in its own partition. Bounds come from the ids alone.
    """
    spark = integer_ids(docs).sparkSession
    n = partitions(spark)
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), "text")
    quantiles = F.percentile_approx("id", [k / n for k in range(1, n)], 10_000) if n > 1 else F.array()
    bounds = sorted(set(keyed.agg(quantiles.alias("q")).first()["q"] or []), reverse=True)
    bucket = F.lit(0)
    if bounds:
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("id")))
    heads = {r["bucket"]: r["head"] for r in keyed.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    slots: dict[int, int] = {}  # a key for each partition, so that buckets don't share one
    for r in spark.range(60 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect():
        slots.setdefault(r["p"], r["id"])
    slot = F.element_at(F.array(*[F.lit(slots.get(b, b)).cast("long") for b in range(n + 1)]), F.col("place.bucket") + 1)
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("guest"))
    places = F.array(own)
    if heads:
        ids = F.create_map(*[x for b in order for x in (F.lit(heads[b]), F.lit(before[b]))])
        previous = F.element_at(ids, F.col("id"))
        guest = F.struct(previous.cast("int").alias("bucket"), F.lit(True).alias("guest"))
        places = F.when(F.col("id").isin(list(heads.values())), F.array(own, guest)).otherwise(places)
    placed = keyed.withColumn("place", F.explode(places)).withColumn("slot", slot)
    placed = placed.select("doc_id", "text", "id", "place.bucket", "place.guest", "slot").repartition(n, "slot")
    return placed.sortWithinPartitions("bucket", "guest", F.desc("id"), "text").select("doc_id", "text", "bucket", "guest")


_ROWS = "text string, bucket int, guest boolean, chunk long, place long"
_OWN = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order, in tables of some megabytes; each begins with the last row of the table before."""
    held: pa.Table | None = None
    for batch in batches:
        for b in slices(batch):
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            held = t.slice(len(t) - 1)
            if len(t) > 1:
                yield t


def _edited(t: pa.Table) -> tuple[list[str], np.ndarray, list[str]]:
    """A chunk's texts, the rows that have the next document beside them, and their edited texts."""
    texts = [x or "" for x in t.column("text").to_pylist()]
    buckets, guest = t.column("bucket").to_numpy(), t.column("guest").to_numpy()
    take = np.flatnonzero(~guest[:-1] & (buckets[1:] == buckets[:-1]))
    edited = []
    for i in take:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    return texts, take, edited


def _compared(t: pa.Table, words: np.ndarray) -> pa.Table:
    texts, take, edited = _edited(t)
    prints = fingerprints(pa.array(texts, pa.large_string()), words)
    after = fingerprints(pa.array(edited, pa.large_string()), words)
    hexed = lambda m: [r.astype(">u4").tobytes().hex() for r in m]
    return pa.Table.from_arrays([
        t.column("doc_id").combine_chunks().take(pa.array(take)), pa.array([len(texts[i]) for i in take], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array(hexed(prints[take]), pa.string()), pa.array(hexed(after), pa.string()),
        pa.array(likeness(prints[take], after)), pa.array(likeness(prints[take], prints[take + 1])),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _compare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            yield from _compared(t, shared.value).to_batches()

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        for b in slices(batch):
            yield pa.Table.from_batches([b])


def _name(tables):
    """Rows with their chunk and their place in it; tables: cuts batches into chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables(batches):
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            t = t.append_column("chunk", pa.array(np.full(len(t), chunk, np.int64))).append_column("place", pa.array(np.arange(len(t))))
            yield from t.to_batches(max_chunksize=10_000)

    return run


def _terms(t: pa.Table) -> np.ndarray:
    """The distinct terms of a chunk's texts and edited texts, sorted; t in order."""
    texts, _, edited = _edited(t)
    return np.unique(X.words(*X.arrow_bytes(pa.array(texts + edited, pa.large_string())), lower=True)[0])


def _ask(bits: int):
    def run(t: pa.Table) -> pa.Table:
        u = _terms(t.sort_by("place"))
        part = (u >> X.U64(64 - bits)).astype(np.int64)
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(u)) if len(u) else np.zeros(0, np.int64)
        return pa.table({"chunk": pa.array(np.full(len(ends), t.column("chunk")[0].as_py(), np.int64)), "part": pa.array(part[ends - 1].astype(np.int32)), "asked": pack(u, 8 * ends)})

    return run


def _answer(asked: pa.Table, terms: pa.Table) -> pa.Table:
    data, ends = unpack(asked.column("asked"))
    known = np.isin(data.view(X.U64), terms.column("h").to_numpy().view(X.U64)).astype(np.uint8)
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "known": pack(known, ends // 8)})


def _known(t: pa.Table, answers: pa.Table) -> np.ndarray:
    """The lexicon's terms in a chunk; t in order."""
    return _terms(t)[unpack(answers.sort_by("part").column("known"))[0] > 0]


def _finish(t: pa.Table, answers: pa.Table) -> pa.Table:
    t = t.sort_by("place")
    return _compared(t, _known(t, answers))


def _joined(docs: DataFrame, named: DataFrame, terms: DataFrame, finish, ddl: str) -> DataFrame:
    """finish over chunks with their terms of the lexicon, which isn't broadcast. named: rows with their chunks, written."""
    rows = named.groupBy("chunk")
    bits = segment_bits(text_bytes(docs))
    parts = terms.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("part"), "h").groupBy("part")
    asked = rows.applyInArrow(_ask(bits), "chunk long, part int, asked binary").groupBy("part")
    answers = asked.cogroup(parts).applyInArrow(_answer, "chunk long, part int, known binary").groupBy("chunk")
    return rows.cogroup(answers).applyInArrow(finish, ddl)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half comes from the next document, and likenesses."""
    terms = band(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if terms.count() <= LEXICON:
        shared = docs.sparkSession.sparkContext.broadcast(_words(terms))
        return in_order(docs).mapInArrow(_compare(shared), f"doc_id {kind}, {_OWN}")
    # written, as chunks get random names
    named = written(in_order(docs).mapInArrow(_name(_chunks), f"doc_id {kind}, {_ROWS}"))
    return _joined(docs, named, terms, _finish, f"doc_id {kind}, {_OWN}")


def _printed(t: pa.Table, words: np.ndarray) -> pa.Table:
    prints = fingerprints(t.column("text"), words)
    return pa.table({"doc_id": t.column("doc_id"), "fingerprint": pa.array([r.astype(">u4").tobytes().hex() for r in prints], pa.string())})


def _print(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                yield from _printed(pa.Table.from_batches([b]), shared.value).to_batches()

    return run


def _print_finish(t: pa.Table, answers: pa.Table) -> pa.Table:
    t = t.sort_by("place")
    return _printed(t, _known(t, answers))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint."""
    terms = band(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, fingerprint string"
    if terms.count() <= LEXICON:
        return docs.select("doc_id", "text").mapInArrow(_print(docs.sparkSession.sparkContext.broadcast(_words(terms))), ddl)
    rows = docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(True).alias("guest"))  # no next documents
    return _joined(docs, written(rows.mapInArrow(_name(_plain), f"doc_id {kind}, {_ROWS}")), terms, _print_finish, ddl)
