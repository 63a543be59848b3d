"""Ranked lexical search by block-max pruning over a forward index.

The index has a row for each page of some PAGE consecutive documents of the scan: its distinct terms with their number of documents;
for each block of BLOCK documents, its terms' largest share of a score (a bound for any document of the block); and, in columns of
their own, each document's terms and counts. It doesn't depend on queries, and is a table that can be opened again.

A batch of queries takes four passes over it. Two read bounds alone: one for the terms' document frequencies, one for the blocks
with a query's highest bounds (the weighted sum of its terms' maxima). These blocks are scored, and the score of the TOP-th best
document there is the query's threshold. Last, every task sorts its pages, and the blocks of each, by how far their bounds exceed
the queries' thresholds, and scores a block's documents for the queries whose bound isn't below their threshold, which rises with
what the task finds; pages without such a block are never decoded. What is left, little more than TOP rows a query, is ranked.
Scores are whole numbers and bounds exact, so nothing that belongs to the result is skipped.

Only a batch's queries go to the tasks: some TERMS distinct terms, or those of one item if it has more; larger query sets take
more batches. Terms are compared by 64-bit hashes.

Cases: a null or empty text has no terms and is never found; an item without terms has no rows; rows with equal item_id are one
item, with the terms of all; a null item_id is an item; repeated documents rank one after the other; a null doc_id comes after all
others of its score; empty tables give no rows; further columns are ignored. Texts that aren't read twice in the same order make
no difference, as the index is read from its table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark.llm import text as X
from foldspark.llm.asks import numbers, rising, slices, unnumbers, unrising
from foldspark.llm.common import integer_ids, table_path

TOP = 50
#: Documents of a page and of a block of it, at most: blocks are small, as bounds of many documents prune little.
PAGE, BLOCK = 128, 8
#: Blocks that are scored first for each query: some more than hold TOP documents.
SEEDS = 10
#: Distinct terms of a batch of queries, about.
TERMS = 1 << 16

SEPARATORS = X.byte_table([b for b in range(128) if not chr(b).isalnum()])
_LAST = np.iinfo(np.int64).max
_BOUNDS = ["terms", "slots", "slot", "most"]
_INDEX = "page string, terms binary, found binary, slots binary, slot binary, most binary, ids array<long>, lengths binary, first binary, term binary, times binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each term: maximal runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return X.words(*X.arrow_bytes(column), lower=True, space=SEPARATORS)


def weight(documents: int, found: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * found + 1)))


def shares(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by: 10^9 tf div (1000 tf + 20 m)."""
    return 1_000_000_000 * times // (1000 * times + 20 * m)


class Index(NamedTuple):
    pages: DataFrame
    documents: int
    terms: int
    block: int


def build(docs: DataFrame, path: str | None = None, page: int = PAGE, block: int = BLOCK) -> Index:
    """Indexes all documents below `path` (a new folder of the shared one)."""
    spark = integer_ids(docs).sparkSession
    path = path or table_path(spark, "search")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for b in slices(batch):
                _, d = tokens(b.column(0))
                documents, terms = documents + int(np.count_nonzero(np.diff(d, prepend=-1))), terms + len(d)
        yield pa.record_batch({"documents": [documents], "terms": [terms]})

    stats = docs.select("text").mapInArrow(count, "documents long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "terms")])
    stats.withColumn("block", F.lit(block)).write.parquet(f"{path}/stats")
    documents, terms, _ = spark.read.parquet(f"{path}/stats").first()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                yield from _pages(b, page, block, documents, terms).to_batches()

    docs.select("doc_id", "text").mapInArrow(index, _INDEX).write.parquet(f"{path}/pages")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was built below `path`."""
    return Index(spark.read.parquet(f"{path}/pages"), *spark.read.parquet(f"{path}/stats").first())


def _packed(x: np.ndarray) -> bytes:
    return numbers(x.astype(np.int32))


def _pages(b: pa.RecordBatch, page: int, block: int, documents: int, terms: int) -> pa.Table:
    """Rows of the index for consecutive documents."""
    h, d = tokens(b.column(1))
    n = X.counts(d, b.num_rows)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(head, append=len(h))
    h, d = h[head], d[head]
    m = 50 + 50 * n * documents // max(terms, 1)
    share = shares(times, m[d])
    ids = b.column(0).cast(pa.int64())
    rows = []
    for lo in range(0, b.num_rows, page):
        hi = min(lo + page, b.num_rows)
        s = slice(*np.searchsorted(d, [lo, hi]))
        if s.start == s.stop:
            continue
        u, local = np.unique(h[s], return_inverse=True)
        slot = (d[s] - lo) // block * len(u) + local
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        most, slot = np.maximum.reduceat(share[s][order], head), slot[head]
        slots = np.bincount(slot // len(u), minlength=-(-(hi - lo) // block))
        name = f"{int(u[0]):016x}-{len(u)}-{ids[lo].as_py()}-{hi - lo}"  # another page of this name would only be scored too
        bounds = [rising(u), _packed(np.bincount(local)), _packed(slots), _packed(np.diff(slot % len(u), prepend=0)), _packed(most)]
        forward = [_packed(x) for x in (np.bincount(d[s] - lo, minlength=hi - lo), np.diff(local, prepend=0), times[s])]
        rows.append((name, *bounds, ids[lo:hi].to_pylist(), numbers(m[lo:hi]), *forward))
    kinds = [pa.string(), *[pa.binary()] * 5, pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names=names)


class Batch:
    """Some queries: their distinct terms, sorted, and which of them each query has."""

    def __init__(self, queries: list[np.ndarray]):
        self.at = np.concatenate([[0], np.cumsum([len(q) for q in queries])]).astype(np.int64)
        self.terms, self.of = np.unique(np.concatenate(queries), return_inverse=True)
        self.weights = np.zeros(len(self.terms), np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the batch's terms a page has, and where in the page."""
        w = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        mine = np.flatnonzero(terms[w] == self.terms)
        return mine, w[mine]

    def sums(self, table: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Rows of values by term, summed over the terms of each query."""
        at, n = self.at[queries], self.at[queries + 1] - self.at[queries]
        start = np.concatenate([[0], np.cumsum(n)])
        of = self.of[np.repeat(at - start[:-1], n) + np.arange(start[-1])]
        return np.add.reduceat(table[:, of], start[:-1], axis=1)


class Page:
    """The bounds of a page's blocks for all queries of a batch; decoded on request."""

    def __init__(self, batch: Batch, row: dict):
        self.batch, self.row = batch, row
        terms = unrising(row["terms"])
        self.mine, self.where = batch.places(terms)
        self.name = np.full(len(terms), -1)
        self.name[self.where] = self.mine
        slots, slot, most = (unnumbers(row[c]) for c in ("slots", "slot", "most"))
        name = self.name[np.cumsum(slot)]
        use = name >= 0
        table = np.zeros((len(slots), len(batch.terms)), np.int64)
        table[np.repeat(np.arange(len(slots)), slots)[use], name[use]] = batch.weights[name[use]] * most[use]
        #: No document of a block scores more for a query.
        self.bounds = batch.sums(table, np.arange(len(batch)))

    def decode(self, block: int) -> None:
        local, times, each = (unnumbers(self.row[c]) for c in ("term", "times", "first"))
        name = self.name[np.cumsum(local)]
        use = name >= 0
        self.doc, self.term, self.block = np.repeat(np.arange(len(each)), each)[use], name[use], block
        self.value = self.batch.weights[self.term] * shares(times[use].astype(np.int64), unnumbers(self.row["lengths"])[self.doc])
        self.ids = np.array([_LAST if i is None else i for i in self.row["ids"]], np.int64)

    def scores(self, k: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids of the block, and their scores for the queries."""
        lo, hi = k * self.block, min((k + 1) * self.block, len(self.ids))
        s = slice(*np.searchsorted(self.doc, [lo, hi]))
        table = np.zeros((hi - lo, len(self.batch.terms)), np.int64)
        table[self.doc[s] - lo, self.term[s]] = self.value[s]
        return self.ids[lo:hi], self.batch.sums(table, queries)


def _frequencies(pages: DataFrame, batch: Batch) -> np.ndarray:
    """How many documents have each of the batch's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(batch.terms), np.int64)
        for b in batches:
            for terms, found in zip(b.column(0), b.column(1), strict=True):
                mine, w = batch.places(unrising(terms.as_py()))
                total[mine] += unnumbers(found.as_py())[w]
        some = np.flatnonzero(total)
        yield pa.record_batch({"t": some, "n": total[some]})

    got = pages.select("terms", "found").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(batch.terms), np.int64)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out


def _best_blocks(pages: DataFrame, batch: Batch, seeds: int) -> DataFrame:
    """(page, k, q): the blocks with the highest bounds of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names, ks = np.zeros((0, len(batch)), np.int64), np.zeros((0, len(batch)), object), np.zeros((0, len(batch)), np.int64)
        for b in batches:
            for row in b.to_pylist():
                bound = Page(batch, row).bounds
                best = np.concatenate([best, bound])
                names = np.concatenate([names, np.full(bound.shape, row["page"], object)])
                ks = np.concatenate([ks, np.broadcast_to(np.arange(len(bound))[:, None], bound.shape)])
                order = np.argsort(-best, axis=0, kind="stable")[:seeds]
                best, names, ks = (np.take_along_axis(x, order, 0) for x in (best, names, ks))
        _, q = some = np.nonzero(best)
        yield pa.record_batch({"q": q, "page": pa.array(names[some].tolist(), pa.string()), "k": ks[some], "bound": best[some]})

    found = pages.select("page", *_BOUNDS).mapInArrow(run, "q long, page string, k long, bound long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "page", "k"))
    return found.withColumn("place", place).filter(F.col("place") <= seeds).select("page", "k", "q")


def _scored(pages: DataFrame, batch: Batch, floor: np.ndarray, top: int, block: int, asked: bool = False) -> DataFrame:
    """(q, score, doc_id): each task's `top` best documents of each query with a score of `floor` or more; asked: rows have the
    (k, q) that are scored, and no others are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(batch))]
        least = np.maximum(floor, 1)
        for b in batches:
            found = []
            for row in b.to_pylist():
                page = Page(batch, row)
                if asked:
                    mine = np.zeros(page.bounds.shape, bool)
                    mine[tuple(np.array([(x["k"], x["q"]) for x in row["asked"]]).T)] = True
                    page.bounds[~mine] = 0
                excess = (page.bounds / least).max(1)
                if excess.max() >= 1:
                    found.append((-excess.max(), len(found), np.argsort(-excess, kind="stable"), page))
            for _, _, order, page in sorted(found, key=lambda x: x[:2]):
                decoded = False
                for k in order:
                    queries = np.flatnonzero(page.bounds[k] >= least)
                    if not len(queries):
                        continue
                    if not decoded:
                        page.decode(block)
                        decoded = True
                    ids, scores = page.scores(k, queries)
                    for j in np.flatnonzero((scores >= least[queries]).any(0)):
                        q, s = queries[j], scores[:, j]
                        some = np.flatnonzero(s >= least[q])
                        s, i = np.concatenate([best[q][0], s[some]]), np.concatenate([best[q][1], ids[some]])
                        first = np.lexsort((i, -s))[:top]
                        best[q] = s[first], i[first]
                        if len(first) == top:
                            least[q] = max(least[q], best[q][0][-1])
        q = np.repeat(np.arange(len(batch)), [len(s) for s, _ in best])
        s, ids = (np.concatenate([x[k] for x in best]) for k in (0, 1))
        yield pa.record_batch({"q": q, "score": s, "doc_id": pa.array(ids, mask=ids == _LAST)})

    return pages.mapInArrow(run, "q long, score long, doc_id long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """found with rank, up to `top`."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def queries(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = tokens(b.column(1))
            at = np.searchsorted(d, np.arange(b.num_rows + 1))
            lists = [np.unique(h[at[k] : at[k + 1]]).view(np.int64) for k in range(b.num_rows)]
            yield pa.record_batch([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<long>").filter("size(terms) > 0")
    return each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def search(index: Index, items: DataFrame, top: int = TOP, seeds: int = SEEDS, most_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's `top` best documents with a score above 0."""
    spark = items.sparkSession
    asked = queries(items)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = 1 + total // most_terms
    out = None
    for k in range(n):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow()
        if part.num_rows == 0 or index.documents == 0:
            continue
        batch = Batch([np.array(x, np.int64).view(X.U64) for x in part.column("terms").to_pylist()])
        batch.weights[:] = [weight(index.documents, int(x)) for x in _frequencies(index.pages, batch)]
        first = F.broadcast(_best_blocks(index.pages, batch, seeds).groupBy("page").agg(F.collect_list(F.struct("k", "q")).alias("asked")))
        tried = _ranked(_scored(index.pages.join(first, "page"), batch, np.zeros(len(batch), np.int64), top, index.block, True), top)
        floor = np.zeros(len(batch), np.int64)
        for r in tried.filter(F.col("rank") == top).select("q", "score").collect():
            floor[r["q"]] = r["score"]
        found = _ranked(_scored(index.pages, batch, floor, top, index.block), top)
        kind = items.schema["item_id"].dataType.simpleString()
        names = spark.createDataFrame(list(enumerate(part.column("item_id").to_pylist())), f"q long, item_id {kind}")
        found = found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long") if out is None else out


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Indexes docs and searches them for every item."""
    return search(build(docs), items)
