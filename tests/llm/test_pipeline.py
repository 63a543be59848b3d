import collections
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb

import __spark_entry__ as entry
import corpus_pipeline as P
from foldspark.llm import bpe, common, jaccard, quality
from foldspark.llm.oracles import ORACLE
from foldspark.sources.shared import shared_dir
from tests.llm.conftest import words
from tests.llm.test_documents import plain_components, plain_mix, plain_redacted

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    judged = duck.sql(ORACLE["op2_quality_rules"])
    kept = {r[0] for r in judged.filter("kept").select("doc_id").fetchall()}
    near = {c for _, _, c, _ in plain_components([(i, rows[i]["text"]) for i in kept])}
    text = {i: plain_redacted(rows[i]["text"]) for i in near}
    size, target = plain_mix([(i, text[i], rows[i]["source"]) for i in near])
    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns == [*docs.columns, "bpe_ids"]
    got = out.collect()
    enc = bpe.encoding(*P.tokenizer())
    times = collections.Counter(r["doc_id"] for r in got)
    assert set(times) <= near and max(times.values()) <= 2
    for r in got:
        assert r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["bpe_ids"] == enc.encode_ordinary(r["text"])
    for i in near:
        s = rows[i]["source"]
        if len(words(text[i])):
            assert int(target[s] / size[s] + 1e-9) <= times[i] <= int(target[s] / size[s]) + 1


def test_stages_keep_columns(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert shared_dir(spark)


def test_intermediate_results_go(spark, tmp_path):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    left = {d: os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{d}") for d in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before}
    assert [v for d, v in left.items() if d.startswith("pipeline-")] == [["4-byte_bpe"]]


def test_results_outlive_the_pipeline(spark):
    """Queries that were built before the pipeline, in any order and in two threads."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    first, second = quality.quality(docs), jaccard.join(docs)
    with ThreadPoolExecutor(2) as pool:
        ran = [pool.submit(lambda: entry.queries()["pipeline"](spark, SF).count()) for _ in range(2)]
        third = jaccard.join(docs)
        assert len({r.result() for r in ran}) == 1
    assert third.count() == second.count() == first.count() == docs.count()


def test_scopes_let_go_of_their_own_tables(spark):
    where = shared_dir(spark).removeprefix("file:")
    outer = common.written(spark.range(3).toDF("a"))
    with common.scope():
        held = common.written(spark.range(5).toDF("a"))
        with common.scope():
            inner = common.written(spark.range(7).toDF("a"))
            assert inner.count() == 7
        early = common.written(spark.range(9).toDF("a"))
        common.discard(early)
        assert held.count() == 5 and not os.path.exists(inner._written_at.removeprefix("file:"))
    assert outer.count() == 3 and not any(os.path.exists(x._written_at.removeprefix("file:")) for x in (held, early))
    assert os.path.exists(where)
