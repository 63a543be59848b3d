"""Substring dedup by compaction of a De Bruijn graph.

A node is K - 1 consecutive words, an edge is a window of K words, from the node of its first to that of its last words.

1. Repeated edges. Chunks of documents send their distinct edges, as short keys, and learn which ones occur in two documents
   or more. A key that stands for two edges lets an edge through, which does no harm; none is lost.
2. Degrees. Repeated edges that follow each other in a text make runs. Each node of a run is sent with the edge that enters and
   the one that leaves it there, or none at the run's ends. A node where all occurrences agree, in all documents, is
   nonbranching.
3. Compaction. Runs are cut at branching nodes. What lies between is a nonbranching path, and whatever document holds one of its
   edges holds all of it: so the documents of a path are those of its edges, and paths, far fewer than edges, are joined.
4. Verification. The words of a path are read at its source coordinates and digested (128 bits of BLAKE2b); equal paths
   are those of equal digests, whatever the hashes before said. The smallest document of a path owns it, and in all other
   documents its windows are removed.

A chunk settles among its own documents first and sends a path once, so a line found everywhere, or a large group of copies,
meets with one row for each chunk.

Cases: a null or empty text has no words and kept_sha256 is that of the empty text; a null doc_id comes after all others;
rows that repeat a doc_id don't remove from each other; texts shorter than K words lose nothing; an empty table gives no rows;
further columns are ignored; doc_id has to be an integer. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm import asks as A
from foldspark.llm import text as X
from foldspark.llm.common import integer_ids, kept, text_bytes

K = 13
#: Keys, distinct within a chunk each, that meet in a part on average, at most.
PART = 1 << 21
#: Bits of a key beyond those that count all words.
MORE_BITS = 8
LAST = np.iinfo(np.int64).max
#: Values of a node's neighbourhood have 48 bits; this one says that it branches within a chunk.
VALUE_BITS, BRANCHES = 48, np.uint64((1 << 48) - 1)


class Keys:
    """Widths of keys for texts of `size` bytes."""

    def __init__(self, size: int, k: int):
        words = size // 5 + 1
        self.k = k
        self.width = min(64, words.bit_length() + MORE_BITS)
        self.bits = A.part_bits(words, PART)
        self.parts = 1 << self.bits

    def short(self, h: np.ndarray) -> np.ndarray:
        return h >> X.U64(64 - self.width)

    def split(self, keys: np.ndarray) -> list[slice]:
        at = A.runs(keys, self.width - self.bits, self.parts)
        return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _least_and_most(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value of each group, which are numbered from 0 without gaps."""
    if not n:
        return value[:0], value[:0]
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(n))
    return np.minimum.reduceat(value[order], first), np.maximum.reduceat(value[order], first)


class Graph:
    """A chunk's words and edges."""

    def __init__(self, t: pa.Table, keys: Keys):
        self.keys, k = keys, keys.k
        self.raw, offsets = X.arrow_bytes(t.column("text"))
        self.hash, self.row, self.start, self.end = X.words(self.raw, offsets, spans=True)
        self.ids = t.column("doc_id").cast(pa.int64()).combine_chunks().fill_null(LAST).to_numpy()
        self.at = np.flatnonzero(X.inside(self.row, k))  # the first words of windows
        self.edges, self.edge = np.unique(keys.short(X.windows(self.hash, k, seed=11)[self.at]), return_inverse=True)

    def repeated(self, answers: list[bytes]) -> None:
        """Marks repeated edges, from the answers to ask_edges()."""
        split = self.keys.split(self.edges)
        known = np.concatenate([np.unpackbits(A.unnumbers(x), count=s.stop - s.start) for x, s in zip(answers, split, strict=True)]).astype(bool)
        self.at = self.at[known[self.edge]]
        here = np.zeros(len(self.hash) + 1, bool)
        here[self.at] = True
        last = np.append(self.row[1:] != self.row[:-1], True)[: len(self.row)]
        after = self.at + 1
        inner = after < len(self.hash)
        goes_on = np.zeros(len(self.at), bool)
        goes_on[inner] = here[after[inner]] & ~last[self.at[inner]]
        self.opens = np.ones(len(self.at), bool)  # a run begins
        self.opens[1:] = ~goes_on[:-1]
        self.closes = ~goes_on
        nodes = X.windows(self.hash, self.keys.k - 1, seed=5)
        at = np.concatenate([self.at, after[self.closes]])
        enters = np.concatenate([np.where(self.opens, X.U64(0x51), self.hash[self.at - 1]), self.hash[self.at[self.closes]]])
        leaves = np.concatenate([self.hash[self.at + self.keys.k - 1], np.full(self.closes.sum(), 0xA7, X.U64)])
        self.value = X.mix(X.mix(enters) * X.U64(3) + leaves) >> X.U64(64 - VALUE_BITS)
        self.nodes, self.node = np.unique(self.keys.short(nodes[at]), return_inverse=True)

    def paths(self, answers: list[bytes]) -> None:
        """Cuts runs at branching nodes, from the answers to ask_nodes(), and digests the paths."""
        split = self.keys.split(self.nodes)
        branching = np.concatenate([np.unpackbits(A.unnumbers(x), count=s.stop - s.start) for x, s in zip(answers, split, strict=True)]).astype(bool)
        first = np.flatnonzero(self.opens | branching[self.node[: len(self.at)]])
        self.length = np.diff(np.append(first, len(self.at)))  # windows of each path
        self.first = self.at[first]
        digests = np.zeros((len(first), 2), np.int64)
        place = np.cumsum(self.end - self.start + 1) - (self.end - self.start + 1)
        words = self._spaced()
        last = self.first + self.length + self.keys.k - 2
        for i, (a, b) in enumerate(zip(place[self.first].tolist(), (place[last] + self.end[last] - self.start[last]).tolist(), strict=True)):
            digests[i] = np.frombuffer(hashlib.blake2b(words[a:b], digest_size=16).digest(), np.int64)
        both = digests.view([("a", np.int64), ("b", np.int64)])[:, 0]
        self.digests, self.path = np.unique(both, return_inverse=True)
        self.owner = self.ids[self.row[self.first]]
        self.least, _ = _least_and_most(self.path, self.owner, len(self.digests))

    def _spaced(self) -> memoryview:
        """The words, a space after each."""
        size = self.end - self.start
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        to = np.ones(len(out), bool)
        to[np.cumsum(size + 1) - 1] = False
        out[to] = self.raw[np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(self.raw) else self.raw
        return memoryview(out)


_ASKED = "chunk long, part int, keys binary, more binary"
_ANSWERS = "chunk long, part int, bits binary"


def _rows(name: int, keys: np.ndarray, more: np.ndarray, split: list[slice]) -> pa.Table:
    return pa.table({
        "chunk": pa.array(np.full(len(split), name, np.int64)), "part": pa.array(np.arange(len(split), dtype=np.int32)),
        "keys": pa.array([A.rising(keys[s]) for s in split], pa.binary()), "more": pa.array([A.numbers(more[s]) for s in split], pa.binary())})


def _ask_edges(keys: Keys):
    def run(name: int, t: pa.Table) -> pa.Table:
        g = Graph(t, keys)
        least, most = _least_and_most(g.edge, g.ids[g.row[g.at]], len(g.edges))
        return _rows(name, g.edges, (least != most).astype(np.uint8), keys.split(g.edges))

    return run


def _collected(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    own = [A.unrising(x) for x in asked.column("keys").to_pylist()]
    u, inverse = np.unique(np.concatenate(own), return_inverse=True)
    return inverse, A.joined(asked.column("more").to_pylist()), len(u), np.cumsum([0, *map(len, own)])


def _bits(asked: pa.Table, found: np.ndarray, at: np.ndarray) -> pa.Table:
    data = [A.numbers(np.packbits(found[a:b])) for a, b in zip(at, at[1:], strict=False)]
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "bits": pa.array(data, pa.binary())})


def _answer_edges(asked: pa.Table) -> pa.Table:
    inverse, several, n, at = _collected(asked)
    found = np.bincount(inverse, 1 + several.astype(np.int64), n) > 1
    return _bits(asked, found[inverse], at)


def _ask_nodes(keys: Keys):
    def run(blob: pa.Table, edges: pa.Table) -> pa.Table:
        g = Graph(A.unpack(blob.column("blob")[0].as_py()), keys)
        g.repeated(A.whole(edges, keys.parts).column("bits").to_pylist())
        least, most = _least_and_most(g.node, g.value, len(g.nodes))
        value = np.where(least == most, least, BRANCHES)
        return _rows(blob.column("chunk")[0].as_py(), g.nodes, value, keys.split(g.nodes))

    return run


def _answer_nodes(asked: pa.Table) -> pa.Table:
    inverse, value, n, at = _collected(asked)
    least, most = _least_and_most(inverse, value, n)
    found = (least != most) | (most == BRANCHES)
    return _bits(asked, found[inverse], at)


def _graph(keys: Keys, blob: pa.Table, answers: pa.Table) -> Graph:
    """A chunk's graph with its paths, from answers to both questions: those on nodes have the parts after those on edges."""
    bits = A.whole(answers, 2 * keys.parts).column("bits").to_pylist()
    g = Graph(A.unpack(blob.column("blob")[0].as_py()), keys)
    g.repeated(bits[: keys.parts])
    g.paths(bits[keys.parts :])
    return g


def _paths(keys: Keys):
    """The chunk's distinct paths, each with the smallest document that holds it there, and where."""

    def run(blob: pa.Table, answers: pa.Table) -> pa.Table:
        g = _graph(keys, blob, answers)
        n = len(g.digests)
        mine = np.flatnonzero(g.owner == g.least[g.path])
        where = np.zeros(n, np.int64)
        where[g.path[mine[::-1]]] = mine[::-1]
        first = np.searchsorted(g.row, g.row[g.first[where]])
        return pa.table({
            "chunk": pa.array(np.full(n, blob.column("chunk")[0].as_py(), np.int64)), "place": pa.array(np.arange(n, dtype=np.int32)),
            "a": pa.array(g.digests["a"].copy()), "b": pa.array(g.digests["b"].copy()), "doc": pa.array(g.least),
            "start": pa.array((g.first[where] - first).astype(np.int32)), "n": pa.array(g.length[where].astype(np.int32))})

    return run


def _strip(keys: Keys):
    def run(blob: pa.Table, answers: pa.Table) -> pa.Table:
        lost = answers.filter(answers.column("part").to_numpy() < 0)
        t = A.unpack(blob.column("blob")[0].as_py())
        g = _graph(keys, blob, answers.filter(answers.column("part").to_numpy() >= 0))
        gone = np.zeros(len(g.digests), bool)
        gone[-1 - lost.column("part").to_numpy()] = True  # paths that another chunk's document owns
        gone = np.flatnonzero(gone[g.path] | (g.owner > g.least[g.path]))
        step = np.zeros(len(g.hash) + 1, np.int64)
        np.add.at(step, g.first[gone], 1)
        np.add.at(step, g.first[gone] + g.length[gone] + keys.k - 1, -1)
        keep = np.cumsum(step[:-1]) == 0
        n, left = X.counts(g.row, len(t)), X.counts(g.row[keep], len(t))
        place = np.cumsum(np.append(0, left))
        size = np.append(0, np.cumsum((g.end - g.start + 1)[keep]))
        words = Graph._spaced(g)
        keep_bytes = np.repeat(keep, g.end - g.start + 1)
        kept = memoryview(np.frombuffer(words, np.uint8)[keep_bytes])
        texts = [bytes(kept[size[place[i]] : max(size[place[i]], size[place[i + 1]] - 1)]) for i in range(len(t))]
        return pa.table({
            "doc_id": t.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(n - left),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), "kept": pa.array([x.decode() for x in texts], pa.string())})

    return run


_PATHS = "chunk long, place int, a long, b long, doc long, start int, n int"


class Compaction:
    """The graph of all documents, compacted."""

    def __init__(self, docs: DataFrame, k: int = K, chunk: int = A.CHUNK):
        self.rows = integer_ids(docs).select("doc_id", "text")
        self.keys = Keys(text_bytes(docs), k)
        self.blobs = A.blobs(self.rows, chunk)
        asked = A.each_chunk(self.rows, _ask_edges(self.keys), _ASKED, chunk)
        edges = kept(asked.groupBy("part").applyInArrow(A.tidied(_answer_edges), _ANSWERS))
        asked = self.by_chunk(edges).applyInArrow(A.tidied(_ask_nodes(self.keys)), _ASKED)
        nodes = kept(asked.groupBy("part").applyInArrow(A.tidied(_answer_nodes), _ANSWERS))
        self.answers = edges.union(nodes.withColumn("part", F.col("part") + self.keys.parts))

    def by_chunk(self, answers: DataFrame):
        return self.blobs.groupBy("chunk").cogroup(answers.groupBy("chunk"))

    def paths(self) -> DataFrame:
        """(chunk, place, a, b, doc, start, n): digests of nonbranching repeated paths, and their first source in each chunk."""
        return self.by_chunk(self.answers).applyInArrow(A.tidied(_paths(self.keys)), _PATHS)

    def dedup(self) -> DataFrame:
        owner = F.min("doc").over(Window.partitionBy("a", "b"))
        lost = self.paths().withColumn("owner", owner).filter("owner < doc")
        lost = lost.select("chunk", (-1 - F.col("place")).alias("part"), F.lit(None).cast("binary").alias("bits"))
        kind = self.rows.schema["doc_id"].dataType.simpleString()
        ddl = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
        return self.by_chunk(self.answers.union(lost)).applyInArrow(A.tidied(_strip(self.keys)), ddl)


def paths(docs: DataFrame, k: int = K, chunk: int = A.CHUNK) -> DataFrame:
    """(a, b, doc, start, n): paths of n windows that two documents or more hold, and their source in the smallest one of each chunk."""
    return Compaction(docs, k, chunk).paths().select("a", "b", "doc", "start", "n")


def dedup(docs: DataFrame, k: int = K, chunk: int = A.CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept: the words that stay, joined by a space."""
    return Compaction(docs, k, chunk).dedup()
