"""Hashes and vectors by column expressions against those of one record at a time."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import hashing as H
from foldspark.operators import vectorize as V
from tests.plain_vectors import hashed, murmur3, vector
from tests.test_stats import record

WORDS = ["", "a", "ab", "abc", "abcd", "hello", "hello, world", "The quick brown fox jumps over the lazy dog", "Über", "中文字", "😀", "x" * 1000, "\x00\x7f", "-" * 7]


def test_hashes_of_all_lengths(spark):
    df = spark.createDataFrame([(WORDS,)], "t array<string>")
    assert df.select(F.expr(H.murmur3("t"))).first()[0] == [murmur3(w.encode()) for w in WORDS]
    known = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}  # published values
    assert {w: h & 0xFFFFFFFF for w, h in zip(WORDS, df.select(F.expr(H.murmur3("t"))).first()[0], strict=True) if w in known} == known


@pytest.mark.parametrize("bins", [1, 2, 10, 50, 1024])
def test_sums_by_bin(spark, bins):
    rng = random.Random(bins)
    rows = [([rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)], [rng.uniform(-5, 5) for _ in range(n)]) for n in (0, 1, 7, 60)]
    df = spark.createDataFrame(rows, "t array<string>, v array<double>")
    got = df.select(H.hash_tokens("t", bins).alias("a"), F.expr(H.hashed("t", bins, "v")).alias("b")).collect()
    for (t, v), r in zip(rows, got, strict=True):
        assert np.allclose(r["a"], hashed([(w, 1.0) for w in t], bins)) and np.allclose(r["b"], hashed(list(zip(t, v, strict=True)), bins))
    assert spark.createDataFrame([(None,)], "t array<string>").select(H.hash_tokens("t", bins)).first()[0] == [0.0] * bins


def records():
    rng = random.Random(1)
    out = [record()]
    for k in range(12):
        r = record()
        r["histogram"] = [rng.randint(0, 9) for _ in range(256)] if k else [0] * 256
        r["byteentropy"] = [rng.randint(0, 9) for _ in range(256)]
        r["strings"] = dict(r["strings"], printabledist=[rng.randint(0, 9) for _ in range(96)], printables=rng.choice([0, 500]), entropy=rng.random())
        r["header"] = {"coff": {"timestamp": 10**9 + k, "machine": rng.choice(["I386", "AMD64"]), "characteristics": rng.sample(WORDS, 4)}, "optional": dict(r["header"]["optional"], dll_characteristics=rng.sample(WORDS, 3))}
        names = rng.sample(["", ".text", ".data", "ü", "rsrc"], 4)
        r["section"] = {"entry": rng.choice([*names, "", "none"]), "sections": [dict(name=n, size=rng.choice([0, 512]), entropy=rng.random() * 8, vsize=rng.randint(0, 10**6), props=rng.sample(["MEM_READ", "MEM_WRITE", "MEM_EXECUTE", "CNT"], rng.randint(0, 4))) for n in names]}
        r["imports"] = {f"{rng.choice(['Kernel', 'KERNEL', 'user'])}{i}.DLL": [f"f{rng.randint(0, 50)}" for _ in range(rng.randint(0, 20))] for i in range(6)}
        r["exports"] = [f"e{rng.randint(0, 30)}" for _ in range(k)]
        r["datadirectories"] = [dict(name="d", size=rng.randint(0, 99), virtual_address=rng.randint(0, 99)) for _ in range(rng.choice([0, 3, 15, 17]))]
        out.append(r)
    return out


def test_vectors_of_records(spark, tmp_path):
    rows = [dict(r, sha256=f"s{i}", label=i % 2, avclass=None) for i, r in enumerate(records())]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    df = spark.read.schema(V.RECORD_SCHEMA).json(str(tmp_path / "r.jsonl"))
    got = {r["sha256"]: r["features"] for r in V.vectorize(df).collect()}
    for r in rows:
        assert np.allclose(got[r["sha256"]], vector(r), rtol=1e-6)
    some = V.vectorize(df, ("exports", "general"))
    assert {len(r["features"]) for r in some.collect()} == {138}
    assert "Python" not in V.vectorize(df)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="version"):
        V.vectorize(df, version=1)


def test_null_blocks_are_zeros(spark):
    df = spark.createDataFrame([("a", 1, "x")], "sha256 string, label int, avclass string").withColumns({c: F.lit(None).cast(t) for c, t in [x.strip().split(" ", 1) for x in _columns()]})
    features = V.vectorize(df).first()["features"]
    assert len(features) == 2381 and not any(features)


def _columns():
    from pyspark.sql.types import _parse_datatype_string

    return [f"{f.name} {f.dataType.simpleString()}" for f in _parse_datatype_string(V.RECORD_SCHEMA) if f.name in V.WIDTHS]
