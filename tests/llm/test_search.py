"""Ranked search against a plain version that scores every document, on ties, nulls, repeated rows, odd letters and small blocks."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from foldspark.llm import search
from foldspark.llm.oracles import ORACLE
from foldspark.llm.queries import QUERIES
from tests.llm.conftest import lower, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def plain(docs, items, top=50):
    terms = [(i, TERM.findall(lower(t))) for i, t in docs]
    some = [x for x in terms if x[1]]
    n_docs, total = len(some), sum(len(t) for _, t in some)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for item, q in asked.items():
        weight = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(x in t for _, t in some) + 1))) for x in q}
        scored = []
        for i, t in some:
            m = 100 - 50 + (50 * len(t) * n_docs) // total
            s = sum(weight[x] * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in q if x in t)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ASKED = [(1, "the cat sat w7 x3 Über5 common3"), (2, None), (3, ""), (4, "... --"), (5, "nothing_of the kind zzz"), (6, "same line"), (6, "x"), (None, "one A B"), (7, "PASSWORD token İ")]


def test_against_plain(spark, docs, empty):
    items = spark.createDataFrame(ASKED, ITEMS)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], ASKED)
    assert rows(search.rank(docs, items)) == want and len(want) > 10
    odd = docs.selectExpr("*", "1 AS q", "2 AS block", "3 AS rank", "4 AS score", "5 AS terms")
    assert rows(search.rank(odd, items.selectExpr("*", "1 AS q", "2 AS doc_id", "3 AS terms"))) == want
    assert search.rank(empty, items).collect() == [] and search.rank(docs, items.limit(0)).collect() == []
    assert search.rank(empty, items).columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(TypeError):
        search.rank(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"), items)


def test_pruning_loses_nothing(spark, tmp_path):
    """Small blocks, few results, batches of few terms; more documents than results; many ties; null and repeated ids."""
    rng = random.Random(3)
    rare = [f"r{i}" for i in range(300)]
    rows_ = [(i // 2 if i % 50 == 0 else i, " ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(900)]
    rows_ += [(2000 + i, "a b r1 r2") for i in range(120)] + [(None, "a b r1 r2"), (None, "r7 r7"), (3000, "r1 " * 5000)]
    items = [(k, " ".join(rng.choices(rare, k=4) + ["a"])) for k in range(25)] + [(99, "r1 r2"), (98, " ".join(rare))]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, ITEMS)
    index = search.build(df, str(tmp_path / "index"), page=31, block=7)
    for top, terms in ((50, 1 << 16), (3, 300)):
        assert rows(search.search(search.opened(spark, str(tmp_path / "index")), asked, top=top, most_terms=terms)) == plain(rows_, items, top)
    assert index.documents == sum(bool(TERM.findall(t)) for _, t in rows_)


def test_blocks_below_the_threshold_are_not_scored(spark, tmp_path):
    rows_ = [(i, "common " + f"w{i % 400}") for i in range(2000)] + [(5000 + i, "needle common") for i in range(60)]
    index = search.build(spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1), str(tmp_path / "i"), page=100, block=20)
    h, _ = search.tokens(pa.array(["needle common"]))
    batch = search.Batch([h])
    batch.weights[:] = [search.weight(index.documents, int(x)) for x in search._frequencies(index.pages, batch)]
    assert len(search._best_blocks(index.pages, batch, 2).collect()) == 2
    pages = [search.Page(batch, r) for r in index.pages.toArrow().to_pylist()]
    bounds = np.concatenate([p.bounds[:, 0] for p in pages])
    assert len(bounds) == 103 and (bounds > bounds.max() / 2).sum() == 3  # only blocks with the rare term have bounds near its scores
    for p in pages:
        p.decode(index.block)
        assert all(p.scores(k, np.array([0]))[1].max() <= p.bounds[k, 0] for k in range(len(p.bounds)))


def test_texts_beyond_a_slice(spark):
    long = " ".join(f"word{i % 5000}" for i in range(900_000)) + " needle"
    rows_ = [(1, long), (2, "needle"), (3, long[: len(long) // 2])]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    items = [(1, "needle word17"), (2, texts()[0][1])]
    assert rows(search.rank(df, spark.createDataFrame(items, ITEMS))) == plain(rows_, items)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES["op11_ranked_search"](spark, sf)
    got = rows(df)
    assert got == sorted(duck.sql(ORACLE["op11_ranked_search"]).select(*df.columns).fetchall(), key=str) and len(got) > 500
