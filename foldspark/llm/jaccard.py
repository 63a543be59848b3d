"""N-gram Jaccard join by prefixes and token combinations.

A document's set holds its distinct shingles of WIDTH words; equal sets are one node.

1. Classes. Chunks of documents send their distinct tokens and learn how many sets hold each: one (no partner can share it), up
   to FREQUENT (rare), or more (frequent). Tokens are ordered by class, then by hash. A set with less than three quarters of
   its tokens in other sets has no partner, which ends most documents, also those that merely share frequent passages.
2. Prefixes. Similar sets that share a rare token share one within their prefixes, as rare tokens come before frequent ones: the
   first of all that they share. So rare tokens of the prefix are indexed one by one.
3. Combinations. Similar sets that share no rare token have all they share among their frequent ones, so three quarters of
   each are frequent. Combinations of three frequent tokens next to each other in the order are indexed (of two, for up to 13):
   each token that only one of two sets has breaks two combinations at most, so sequences of a and b tokens, i of them common,
   keep 5 * i - 2 * (a + b) - 2 or more common ones, which is positive from a + b = 21 on (of two: 3 * i - (a + b) - 1).
   An index entry links its sets in a chain by size, not to each other, and the chain breaks where sizes differ too much.
4. Verification. Sets that chains connect meet by their whole token sets, in tasks of two blocks of up to BLOCK sets each, so no
   task holds a large family. A task verifies the pairs that share a token of their prefixes (rarest first), and returns how
   many links each set has and a spanning forest of them, not the links. Links are counted exactly, so time grows with
   the square of a family's different sets, though not of its copies.

Classes come from short keys, and copies in different chunks count as several sets: both only move a token to a higher class, and
no result depends on classes. Sets and tokens are 64-bit hashes.

Cases: a null, empty or wordless text has an empty set and no links; fewer than WIDTH words are one shingle; rows that repeat a
doc_id are documents with one id, linked if they are similar; a null doc_id is never the least of a component; an empty table
gives no rows; further columns are ignored by `join` and carried by `representatives`; doc_id has to be an integer. Texts are
read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm import asks as A
from foldspark.llm import text as X
from foldspark.llm.common import integer_ids, join_hot, kept, partitions, small, text_bytes, written
from foldspark.llm.components import components

WIDTH = 5
NUMERATOR, DENOMINATOR = 3, 4  # similarity 0.75
#: A token of more sets than this is frequent.
FREQUENT = 64
#: Sets in a block, at most on average.
BLOCK = 1024
#: Keys, distinct within a chunk each, that meet in a part on average, at most, and their bits beyond those that count all tokens.
PART, MORE_BITS = 1 << 21, 8
UNIQUE, RARE, COMMON = 0, 1, 2
DOC, ENTRY, SET = 0, 1, 2
_ROW = "kind int, key long, sid long, n int, m int, tokens binary"


def sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, token) pairs sorted and distinct, the sizes of the sets and their ids (0: empty)."""
    n = len(offsets) - 1
    h, d = X.words(raw, offsets, lower=True)
    ok = X.inside(d, WIDTH)
    token, owner = X.windows(h, WIDTH)[ok], d[: len(ok)][ok]
    words = X.counts(d, n)
    short = np.flatnonzero((words > 0) & (words < WIDTH))
    if len(short):
        at = np.searchsorted(d, short)
        total = np.full(len(short), 0x5107, X.U64)
        for j in range(WIDTH - 1):
            more = words[short] > j
            total[more] = X.mix(total[more] * X.U64(31) + h[at[more] + j])
        token, owner = np.concatenate([token, total]), np.concatenate([owner, short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    head = np.ones(len(token), bool)
    head[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[head], owner[head]
    size = X.counts(owner, n)
    total = np.zeros(len(token) + 1, X.U64)
    np.cumsum(X.mix(token), out=total[1:])
    end = np.cumsum(size)
    sid = X.mix(total[end] - total[end - size] + size.astype(X.U64))
    sid[size == 0] = 0
    return owner, token, size, sid


def least_common(n):
    """Tokens of a set of n that any partner shares."""
    return (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR


def similar(i, a, b):
    return DENOMINATOR * i >= NUMERATOR * (a + b - i)


class Keys:
    def __init__(self, size: int):
        words = size // 5 + 1
        self.width = min(64, words.bit_length() + MORE_BITS)
        self.bits = A.part_bits(words, PART)
        self.parts = 1 << self.bits

    def split(self, keys: np.ndarray, width: int) -> list[slice]:
        at = A.runs(keys, width - self.bits, self.parts)
        return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


class Sets:
    """A chunk's documents, and the distinct sets of more than no tokens among them."""

    def __init__(self, t: pa.Table, keys: Keys):
        d, token, self.size, self.sid = sets(*X.arrow_bytes(t.column("text")))
        self.sids, first = np.unique(self.sid[self.size > 0], return_index=True)
        self.first = np.flatnonzero(self.size > 0)[first]  # a document for each set
        number = np.full(len(self.size), -1)
        number[self.first] = np.arange(len(self.first))
        take = number[d] >= 0
        owner, token = number[d][take], token[take]
        order = np.argsort(owner, kind="stable")
        self.owner, self.token = owner[order], token[order]
        self.n = self.size[self.first]
        self.keys, self.key = np.unique(self.token >> X.U64(64 - keys.width), return_inverse=True)


_ASKED = "chunk long, part int, keys binary, counts binary, sids binary"
_ANSWERS = "chunk long, part int, classes binary, own binary"


def _ask(keys: Keys):
    def run(name: int, t: pa.Table) -> pa.Table:
        s = Sets(t, keys)
        counts = np.bincount(s.key, minlength=len(s.keys)).astype(np.uint32)
        split = keys.split(s.keys, keys.width)
        return pa.table({
            "chunk": pa.array(np.full(keys.parts, name, np.int64)), "part": pa.array(np.arange(keys.parts, dtype=np.int32)),
            "keys": pa.array([A.rising(s.keys[x]) for x in split], pa.binary()), "counts": pa.array([A.numbers(counts[x]) for x in split], pa.binary()),
            "sids": pa.array([A.rising(s.sids[x]) for x in keys.split(s.sids, 64)], pa.binary())})

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Classes of a part's tokens; and of its sets, which chunk is the one that speaks for them."""
    own = [A.unrising(x) for x in asked.column("keys").to_pylist()]
    _, inverse = np.unique(np.concatenate(own), return_inverse=True)
    n = np.bincount(inverse, A.joined(asked.column("counts").to_pylist()))
    classes = np.where(n <= 1, UNIQUE, np.where(n <= FREQUENT, RARE, COMMON)).astype(np.uint8)[inverse]
    at = np.cumsum([0, *map(len, own)])
    names = asked.column("chunk").to_numpy()
    each = [A.unrising(x) for x in asked.column("sids").to_pylist()]
    sids, which = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
    order = np.lexsort((names[which], sids))
    head = np.ones(len(order), bool)
    head[1:] = sids[order][1:] != sids[order][:-1]
    speaks = np.zeros(len(order), np.uint8)
    speaks[order[head]] = 1
    to = np.cumsum([0, *map(len, each)])
    return pa.table({
        "chunk": asked.column("chunk"), "part": asked.column("part"),
        "classes": pa.array([A.numbers(classes[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary()),
        "own": pa.array([A.numbers(speaks[a:b]) for a, b in zip(to, to[1:], strict=False)], pa.binary())})


def _rows(kind: int, key: np.ndarray, sid: np.ndarray, n: np.ndarray, m=None, tokens: list[bytes] | None = None) -> pa.Table:
    size = len(sid)
    return pa.table({
        "kind": pa.array(np.full(size, kind, np.int32)), "key": key if isinstance(key, pa.Array) else pa.array(key.view(np.int64)), "sid": pa.array(sid.view(np.int64)),
        "n": pa.array(n.astype(np.int32)), "m": pa.array(np.zeros(size, np.int32) if m is None else m), "tokens": pa.array(tokens, pa.binary()) if tokens is not None else pa.nulls(size, pa.binary())})


def entries(owner: np.ndarray, token: np.ndarray, kind: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys and the sets that they belong to. Tokens come by set, then in the order; n: sizes of all sets."""
    count = np.bincount(owner, minlength=len(n))
    within = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    single = (kind == RARE) & (within < (n - least_common(n) + 1)[owner])
    keys, who = [X.mix(token[single] ^ X.U64(0x51))], [owner[single]]
    frequent = np.bincount(owner[kind == COMMON], minlength=len(n))
    take = (kind == COMMON) & (frequent >= least_common(n))[owner]
    d, t = owner[take], token[take]
    for k, fits in ((2, frequent <= 13), (3, frequent >= 11)):
        ok = X.inside(d, k)
        ok &= fits[d[: len(ok)]]
        keys.append(X.windows(t, k, seed=k)[ok])
        who.append(d[: len(ok)][ok])
    return np.concatenate(keys), np.concatenate(who)


def chain(key: np.ndarray, sid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of neighbours among rows sorted by key and size, where sizes allow similarity."""
    ok = (key[1:] == key[:-1]) & (NUMERATOR * n[1:] <= DENOMINATOR * n[:-1]) & (sid[1:] != sid[:-1])
    return sid[:-1][ok], sid[1:][ok]


def _links(u: np.ndarray, v: np.ndarray) -> pa.Table:
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), X.U64)
    return _rows(ENTRY, pair[:, 0].copy(), pair[:, 1].copy(), np.zeros(len(pair)), np.ones(len(pair), np.int32))


def _index(keys: Keys):
    """Rows of documents; index entries and token sets of those sets that may have a partner, once for all chunks."""

    def run(blob: pa.Table, answers: pa.Table) -> pa.Table:
        t = A.unpack(blob.column("blob")[0].as_py())
        answers = A.whole(answers, keys.parts)
        s = Sets(t, keys)
        kind = A.joined(answers.column("classes").to_pylist())[s.key]
        own = A.joined(answers.column("own").to_pylist()).astype(bool)
        shared = np.bincount(s.owner[kind != UNIQUE], minlength=len(s.n))
        stays = own & (shared >= least_common(s.n))
        take = stays[s.owner]
        owner, token, kind = s.owner[take], s.token[take], kind[take]
        order = np.lexsort((token, kind, owner))
        key, who = entries(owner[order], token[order], kind[order], s.n)
        # of a key's sets of nearly one size, which are linked here, only the smallest and the largest go on
        near = np.floor(np.log(np.maximum(s.n, 1)) / np.log(1.1)).astype(np.int64)
        order = np.lexsort((s.sids[who], s.n[who], key))
        key, who = key[order], who[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (near[who][1:] != near[who][:-1])
        last = np.append(first[1:], True)[: len(first)]
        inner = np.flatnonzero(~first)
        out = _links(s.sids[who[inner - 1]], s.sids[who[inner]])
        ends = first | last
        sets_ = np.flatnonzero(stays)
        at = np.searchsorted(owner, np.append(sets_, len(s.n)))
        data = [token[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        doc = t.column("doc_id").cast(pa.int64()).combine_chunks()
        return pa.concat_tables([
            _rows(DOC, doc, s.sid, s.size, t.column("row").to_numpy()), _rows(ENTRY, key[ends], s.sids[who[ends]], s.n[who[ends]]), out,
            _rows(SET, s.sids[sets_], s.sids[sets_], s.n[sets_], None, data)])

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from entries that come sorted by key and size; the last row of a batch is held over."""
    held: tuple | None = None
    for b in batches:
        key, sid, n = (b.column(i).to_numpy() for i in range(3))
        if held is not None:
            key, sid, n = (np.concatenate([[h], x]) for h, x in zip(held, (key, sid, n), strict=True))
        if len(key):
            held = key[-1], sid[-1], n[-1]
        u, v = chain(key, sid, n)
        pair = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["u", "v"])


def verified(tokens: list[np.ndarray], side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later ones similar to it; with sides, only those of the other side."""
    size = np.array([len(t) for t in tokens])
    start = np.cumsum(size) - size
    _, flat, df = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(size)), size)
    ranked = flat[np.lexsort((flat, df[flat], owner))]  # rarest first
    within = np.arange(len(flat)) - np.repeat(start, size)
    short = size - least_common(size) + 1
    lead = within < np.repeat(short, size)
    by = np.lexsort((owner[lead], ranked[lead]))
    posting, who = ranked[lead][by], owner[lead][by]
    lo, hi = np.searchsorted(posting, np.arange(len(df))), np.searchsorted(posting, np.arange(len(df)), "right")
    mark = np.zeros(len(df), bool)
    seen = np.zeros(len(size), bool)
    for p in range(len(size)):
        seen[:] = False
        for t in ranked[start[p] : start[p] + short[p]]:
            seen[who[lo[t] : hi[t]]] = True
        seen[: p + 1] = False
        near = np.flatnonzero(seen)
        near = near[DENOMINATOR * np.minimum(size[near], size[p]) >= NUMERATOR * np.maximum(size[near], size[p])]
        if side is not None:
            near = near[side[near] != side[p]]
        if not len(near):
            continue
        own = flat[start[p] : start[p] + size[p]]
        mark[own] = True
        n = size[near]
        places = np.repeat(start[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.add.reduceat(mark[flat[places]].astype(np.int64), np.cumsum(n) - n)
        mark[own] = False
        found = near[similar(common, n, size[p])]
        if len(found):
            yield p, found


def _verify(t: pa.Table) -> pa.Table:
    """Of two blocks of a family, or of one and itself: links of each set, copies counted, and a forest that spans them."""
    sid, first = np.unique(t.column("sid").to_numpy(), return_index=True)
    column = t.column("tokens").combine_chunks()
    tokens = [np.frombuffer(column[int(i)].as_buffer(), X.U64) for i in first]
    copies = t.column("copies").to_numpy()[first]
    block = t.column("block").to_numpy()[first]
    links = np.zeros(len(sid), np.int64)
    up = np.arange(len(sid))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for p, found in verified(tokens, block if t.column("i")[0].as_py() != t.column("j")[0].as_py() else None):
        links[p] += copies[found].sum()
        links[found] += copies[p]
        top = root(p)
        for x in np.unique(up[found]):
            r = root(int(x))
            top, other = min(top, r), max(top, r)
            up[other] = top
        up[found] = top
    some = np.flatnonzero(links)
    least = np.array([root(int(x)) for x in some], np.int64)
    return pa.table({"sid": sid[some], "links": links[some], "family": sid[least] if len(some) else sid[:0], "blocks": np.full(len(some), t.column("blocks")[0].as_py(), np.int32)})


def nodes(docs: DataFrame, chunk: int = A.CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, sid, n) for each row, and (sid, links, family) for sets with a partner. Only the former are as many as documents."""
    spark = integer_ids(docs).sparkSession
    rows = docs.select("doc_id", "text", row_hash().alias("row"))
    keys = Keys(text_bytes(docs))
    answers = kept(A.each_chunk(rows, _ask(keys), _ASKED, chunk).groupBy("part").applyInArrow(A.tidied(_answer), _ANSWERS))
    all_ = kept(A.blobs(rows, chunk).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(A.tidied(_index(keys)), _ROW))
    docs_ = all_.filter(F.col("kind") == DOC).select(F.col("key").alias("doc_id"), F.col("m").alias("row"), "sid", "n")
    index = all_.filter((F.col("kind") == ENTRY) & (F.col("m") == 0)).select("key", "sid", "n")
    index = index.repartition(partitions(spark), "key").sortWithinPartitions("key", "n", "sid")
    near = all_.filter((F.col("kind") == ENTRY) & (F.col("m") == 1)).select(F.greatest("key", "sid").alias("u"), F.least("key", "sid").alias("v"))
    found = components(index.mapInArrow(_chained, "u long, v long").union(near))
    labels = written(found.select(F.col("u").alias("sid"), F.col("v").alias("part")).union(small(found.select("v", "v").distinct())))
    sizes = labels.groupBy("part").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    labels = labels.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    copies = docs_.filter("n > 0").groupBy("sid").agg(F.count("*").alias("copies"))
    whole = all_.filter(F.col("kind") == SET).select("sid", "tokens").join(labels, "sid").join(copies, "sid")
    tasks = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    checked = tasks.groupBy("part", "i", "j").applyInArrow(A.tidied(_verify), "sid long, links long, family long, blocks int")
    checked = kept(checked)
    links = checked.groupBy("sid").agg(F.sum("links").alias("links"))
    one = checked.filter("blocks = 1").select("sid", "family")
    several = checked.filter("blocks > 1 and sid <> family").select(F.greatest("sid", "family").alias("u"), F.least("sid", "family").alias("v"))
    if not several.isEmpty():
        joined = components(several)
        one = one.union(joined.select(F.col("u").alias("sid"), F.col("v").alias("family"))).union(joined.select("v", "v").distinct())
    return docs_, written(small(links.join(one, "sid")))


def classes(rows: DataFrame, family: DataFrame) -> DataFrame:
    """(sid, copies, first, links, class) of the sets of nodes(): first is the least (null, doc_id, row) of their documents, links the
    number of documents that each of these is linked with, class one set of their component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
    sets_ = rows.filter("n > 0").groupBy("sid").agg(F.count("*").alias("copies"), first)
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return sets_.join(family, "sid", "left").select("sid", "copies", "first", links.alias("links"), F.coalesce("family", "sid").alias("class"))


def join(docs: DataFrame, chunk: int = A.CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, a row for each row of docs."""
    rows, family = nodes(docs, chunk, block)
    sets_ = kept(classes(rows, family))
    least = sets_.groupBy("class").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("sets"))
    named = join_hot(sets_.select("sid", "class", "links", "copies"), least, "class", "sets").select("sid", "component_id", "links", "copies")
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("links").cast("long").alias("n_links")]
    some = join_hot(rows.filter("n > 0").select("doc_id", "n", "sid"), named, "sid", "copies").select(*columns)
    none = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).alias("links")).select(*columns)
    return some.union(none)


def row_hash() -> F.col:
    """Tells rows with one doc_id apart by their texts."""
    return F.pmod(F.xxhash64("text"), F.lit(2147483647)).cast("int")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component: that with its least doc_id (null ones come last). Empty sets are components of their own;
    rows that repeat both id and text are one.

    Rows are picked in a sort-merge join at every size, so that small inputs don't behave otherwise than large ones.
    """
    rows, family = nodes(docs)
    some = classes(rows, family).groupBy("class").agg(F.min("first").alias("first")).select("first.doc_id", "first.row")
    ids = some.union(rows.filter("n = 0").select("doc_id", "row").distinct()).toDF("kept_id", "kept_row")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), row_hash().alias("row"))
    chosen = packed.join(ids.hint("merge"), packed["id"].eqNullSafe(ids["kept_id"]) & (packed["row"] == ids["kept_row"]), "left_semi")
    if rows.groupBy("doc_id", "row").count().filter("count > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("id", "row").orderBy(F.xxhash64("doc")))
        chosen = chosen.withColumn("place", place).filter("place = 1")
    return chosen.select("doc.*")
