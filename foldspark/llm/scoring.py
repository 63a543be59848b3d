"""Language-model scoring with a log-frequency Bloom filter.

The filter holds the counts of pairs and triples of tokens over all training texts, quantised: an n-gram of level q, whose count
is about BASE ** (q - 1), is stored as q entries (n-gram, 1) to (n-gram, q), and a reader probes level after level until the
first miss. The filter grows with the corpus, and no counted n-gram is left out, so it has no size bound under which it could be
broadcast whole: it is cut into segments by the hash of the context, each built in the task that adds up its counts, and chunks
of documents send their n-grams to the segments and get the probed levels back.

Probabilities are smoothed from one order to the next. Tokens have the contract's additive probability p1, from exact counts.
For the contexts of one and of two tokens, p = (count + MU * lower) / (total + MU), where count is the probed one, and total
is the sum of probed counts over all of the context's n-grams, which its segment returns as well. So what a context doesn't
give to its n-grams goes to the lower order, and each context's probabilities sum to 1 over the vocabulary and one unknown
token, but for false positives among n-grams that no text holds, whose share a filter of BITS_PER_ENTRY bits keeps near 1 %.

A context that is so frequent that its n-grams would fill a segment (HOT tokens or a share of 1 in HOT_SHARE) is cut by the hash
of the token that follows, and its total is added up from its cuts.

Cases: a null or empty text is its end token alone; a null doc_id is in training; repeated rows are scored each by itself, and
count twice in training; an empty table gives no rows; further columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import asks as A
from foldspark.llm import text as X
from foldspark.llm.common import text_bytes, written

PROBES = 5
BITS_PER_ENTRY = 10
BASE = 1.5
SMOOTHING = 0.1
#: Weight of the lower order, in tokens, for contexts of one and of two tokens.
MU = (32.0, 4.0)
#: N-grams, distinct within a chunk each, that meet in a segment on average, at most.
SEGMENT = 1 << 21
#: A context is cut when it has more training tokens than both this number and this share of all.
HOT, HOT_SHARE = 1 << 20, 1 << 12
#: Bits of a key that tell the tokens after one context apart, and bits of the context beyond those that count all tokens.
WORD_BITS, MORE_BITS = 24, 8
END = np.uint64(0xE4D0E4D0E4D0E4D1)
START = np.uint64(0x57A4757A4757A475)


def sequences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Token hashes with an end token after each text, the hashes of the contexts of one and two tokens, and text indices."""
    h, d = X.words(raw, offsets, lower=True)
    n = len(offsets) - 1
    docs = np.concatenate([d, np.arange(n)])
    order = np.argsort(docs, kind="stable")
    tokens = np.concatenate([h, np.full(n, END)])[order]
    docs = docs[order]
    before = [np.full(len(tokens), START), np.full(len(tokens), START)]
    for k in (1, 2):
        inner = np.flatnonzero(docs[k:] == docs[:-k]) + k
        before[k - 1][inner] = tokens[inner - k]
    one = X.mix(before[0] * X.U64(0x9E3779B97F4A7C15))
    two = X.mix(one + X.mix(before[1] ^ X.U64(0xB1)) * X.U64(3))
    return tokens, [one, two], docs


def hot_contexts(docs: DataFrame, tokens: int) -> dict[int, int]:
    """Contexts to be cut, and into how many parts each. tokens: about how many there are."""
    most = max(HOT, tokens // HOT_SHARE)
    if tokens <= most:
        return {}

    def find(_: int, t: pa.Table) -> pa.Table:
        _, contexts, _ = sequences(*X.arrow_bytes(t.column("text")))
        names, counts = [], []
        for c in contexts:
            least = max(16, len(c) // (2 * HOT_SHARE))
            c = c[(np.bincount(c >> X.U64(48), minlength=1 << 16) >= least)[c >> X.U64(48)]]
            u, n = np.unique(c, return_counts=True)
            names.append(u[n >= least])
            counts.append(n[n >= least])
        return pa.table({"h": np.concatenate(names).view(np.int64), "n": np.concatenate(counts)})

    found = A.each_chunk(docs.select("text"), find, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    return {r["h"] % (1 << 64): -(-r["n"] // most) for r in found.collect()}  # at most 2 * HOT_SHARE for each order


def level(n: np.ndarray) -> np.ndarray:
    """0 for none, 1 for a count of 1, and one more for each factor of BASE."""
    return np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / math.log(BASE) + 1e-9) + 1, 0).astype(np.int32)


def _estimates() -> np.ndarray:
    lo = [math.ceil(BASE ** (q - 1) - 1e-9) for q in range(1, 102)]
    return np.array([0, *[(a + b - 1) // 2 for a, b in zip(lo, lo[1:], strict=False)]], np.int64)


#: The count that a level stands for: the middle of the whole numbers in its range.
ESTIMATES = _estimates()


def _positions(h: np.ndarray, j: int, size: int) -> Iterator[np.ndarray]:
    """Bit positions of entry (h, j) in a segment of size bits, a power of two."""
    x = X.mix(h + X.U64(j * 0xD1B54A32D192ED03 % (1 << 64)))
    mask = X.U64(size - 1)
    step = (x >> X.U64(32)) | X.U64(1)
    for i in range(PROBES):
        yield (x + X.U64(i) * step) & mask


def fill(h: np.ndarray, q: np.ndarray, each: int = BITS_PER_ENTRY) -> np.ndarray:
    """A segment's bits, packed: at least `each` for each of its entries."""
    bits = np.zeros(1 << max(10, int(each * q.sum(dtype=np.int64)).bit_length()), bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for p in _positions(h[q >= j], j, len(bits)):
            bits[p.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Level of each n-gram: levels are probed in turn until one is missing."""
    q = np.zeros(len(h), np.uint8)
    live = np.arange(len(h))
    for j in range(1, len(ESTIMATES)):
        if not len(live):
            break
        found = np.ones(len(live), bool)
        for p in _positions(h[live], j, 8 * len(bits)):
            found &= (bits[(p >> X.U64(3)).astype(np.int64)] >> (p & X.U64(7)).astype(np.uint8)) & 1 > 0
        live = live[found]
        q[live] = j
    return q


class Keys:
    """How tokens and n-grams become keys: a context's bits, then the following token's."""

    def __init__(self, size: int, hot: dict[int, int]):
        tokens = size // 5 + 1
        self.width = min(62, tokens.bit_length() + MORE_BITS + WORD_BITS)
        self.bits = min(A.part_bits(tokens, SEGMENT), self.width - WORD_BITS)
        self.parts = 1 << self.bits
        self.hot_at = np.array(sorted(hot), X.U64)
        self.hot_cuts = np.array([hot[h] for h in sorted(hot)], X.U64)

    def _cut(self, context: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return X.mix(context + cut * X.U64(0x9E3779B97F4A7C15)) >> X.U64(64 - self.width + WORD_BITS)

    def hot(self, context: np.ndarray) -> np.ndarray:
        """The number of cuts of each context, 0 for one that isn't cut."""
        if not len(self.hot_at):
            return np.zeros(len(context), X.U64)
        at = np.minimum(np.searchsorted(self.hot_at, context), len(self.hot_at) - 1)
        return np.where(self.hot_at[at] == context, self.hot_cuts[at], X.U64(0))

    def of(self, tokens: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each n-gram; and a key without a token for each cut of each hot context that is there, with all its cuts."""
        after = X.mix(tokens ^ X.U64(0x5BD1E995))
        cuts = self.hot(context)
        some = cuts > 0
        cut = np.zeros(len(tokens), X.U64)
        cut[some] = after[some] % cuts[some]
        key = (self._cut(context, cut) << X.U64(WORD_BITS)) | (after >> X.U64(64 - WORD_BITS))
        extra = [self.cuts(h) for h in np.unique(context[some])]
        return key, np.concatenate([key[:0], *[x << X.U64(WORD_BITS) for x in extra]])

    def cuts(self, h: np.uint64) -> np.ndarray:
        """The contexts that a hot one is cut into."""
        return self._cut(np.array(h, X.U64), np.arange(int(self.hot(np.array([h], X.U64))[0]), dtype=X.U64))

    def order(self, k: int, tokens: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of n-grams of k + 1 tokens, and the place of each token's among them."""
        if not k:
            key, every = tokens, tokens
        else:
            key, extra = self.of(tokens, contexts[k - 1])
            every = np.concatenate([key, extra]) if len(extra) else key
        u, place = np.unique(every, return_inverse=True)
        return u, place[: len(key)].astype(np.int32)


_NAMES = ("one", "two", "three")
_ASKED = "chunk long, part int, " + ", ".join(f"{n} binary, {n}_n binary" for n in _NAMES)
_ANSWERS = "chunk long, part int, tokens long, kinds long, one binary, two binary, two_all binary, three binary, three_all binary"


def _ask(keys: Keys):
    def run(name: int, t: pa.Table) -> pa.Table:
        tokens, contexts, docs = sequences(*X.arrow_bytes(t.column("text")))
        train = ~t.column("held_out").to_numpy()[docs]
        columns = {"chunk": pa.array(np.full(keys.parts, name, np.int64)), "part": pa.array(np.arange(keys.parts, dtype=np.int32))}
        for order in range(3):
            u, place = keys.order(order, tokens, contexts)
            n = np.bincount(place[train], minlength=len(u)).astype(np.uint32)
            at = A.runs(u, (keys.width if order else 64) - keys.bits, keys.parts)
            columns[_NAMES[order]] = pa.array([A.rising(u[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
            columns[f"{_NAMES[order]}_n"] = pa.array([A.numbers(n[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.table(columns)

    return run


def _totals(u: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of sorted keys, and the sum of counts of each."""
    c = u >> X.U64(WORD_BITS)
    first = np.flatnonzero(np.diff(c, prepend=~c[:1])) if len(c) else np.zeros(0, np.int64)
    return c[first], np.add.reduceat(count, first) if len(first) else count


def _answer(bits: int):
    return lambda asked: _segment(asked, bits)


def _segment(asked: pa.Table, bits: int) -> pa.Table:
    """One segment: counts of all chunks are added up, the filter is filled, and each chunk's n-grams are probed."""
    out = {"chunk": asked.column("chunk"), "part": asked.column("part")}
    several = len(asked)
    for order, name in enumerate(_NAMES):
        own = [A.unrising(x) for x in asked.column(name).to_pylist()]
        u, inverse = np.unique(np.concatenate(own), return_inverse=True)
        n = np.zeros(len(u), np.int64)
        np.add.at(n, inverse, A.joined(asked.column(f"{name}_n").to_pylist()).astype(np.int64))
        at = np.cumsum([0, *map(len, own)])
        inverse = inverse.astype(np.int32)
        if not order:
            out["tokens"] = pa.array([int(n.sum())] + [0] * (several - 1), pa.int64())  # the segment's, once
            out["kinds"] = pa.array([int((n > 0).sum())] + [0] * (several - 1), pa.int64())
            small = n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)
            out[name] = pa.array([A.numbers(small[inverse[a:b]]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
            continue
        q = level(n)
        found = probe(fill(u[q > 0], q[q > 0], bits), u)
        contexts, totals = _totals(u, ESTIMATES[found])
        levels, sums = [], []
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            levels.append(A.numbers(found[inverse[a:b]]))
            sums.append(A.numbers(totals[np.searchsorted(contexts, _totals(own[k], own[k])[0])]))
        out[name], out[f"{name}_all"] = pa.array(levels, pa.binary()), pa.array(sums, pa.binary())
    return pa.table(out).select([c.split()[0] for c in _ANSWERS.split(", ")])


def _scorer(keys: Keys, total: int, kinds: int):
    below = total + SMOOTHING * (kinds + 1)

    def run(blob: pa.Table, answers: pa.Table) -> pa.Table:
        t = A.unpack(blob.column("blob")[0].as_py())
        answers = A.whole(answers, keys.parts)
        tokens, contexts, docs = sequences(*X.arrow_bytes(t.column("text")))
        n = len(t)
        place = keys.order(0, tokens, contexts)[1]
        count = A.joined(answers.column("one").to_pylist()).astype(np.float64)
        p = ((count + SMOOTHING) / below)[place]
        base = np.bincount(docs, np.log10(p), n)
        known = np.bincount(docs, (count > 0)[place], n)
        for order, mu in enumerate(MU, 1):
            c = ESTIMATES[A.joined(answers.column(_NAMES[order]).to_pylist())].astype(np.float64)
            sums = A.joined(answers.column(f"{_NAMES[order]}_all").to_pylist()).astype(np.float64)
            u, place = keys.order(order, tokens, contexts)
            names, _ = _totals(u, u)
            total_of = sums[np.searchsorted(names, u >> X.U64(WORD_BITS))][place]
            context = contexts[order - 1]
            hot = np.flatnonzero(keys.hot(context) > 0)
            if len(hot):
                found, which = np.unique(context[hot], return_inverse=True)
                total_of[hot] = np.array([sums[np.searchsorted(names, np.unique(keys.cuts(h)))].sum() for h in found])[which]
            p = (c[place] + mu * p) / (total_of + mu)
        return pa.table({
            "doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(X.counts(docs, n)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(base), "score": pa.array(np.bincount(docs, np.log10(p), n))})

    return run


def score(docs: DataFrame, chunk: int = A.CHUNK, bits: int = BITS_PER_ENTRY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; in chunks of some bytes, with a filter of some bits an entry."""
    tenth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", tenth.alias("held_out"))
    size = text_bytes(docs) + docs.count()
    keys = Keys(size, hot_contexts(rows, size // 5))
    answers = written(A.each_chunk(rows, _ask(keys), _ASKED, chunk).groupBy("part").applyInArrow(A.tidied(_answer(bits)), _ANSWERS))
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = A.blobs(rows, chunk).groupBy("chunk").cogroup(answers.drop("tokens", "kinds").groupBy("chunk"))
    return both.applyInArrow(A.tidied(_scorer(keys, sums["tokens"] or 0, sums["kinds"] or 0)), ddl)
