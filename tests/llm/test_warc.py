"""WARC bundles: round trips, frames and seek tables, lookups by id, equal payloads, and odd pages."""

import base64
import collections
import hashlib
import os
import struct

import duckdb
import pytest
import zstandard

from foldspark.llm import warc
from foldspark.llm.oracles import ORACLE
from foldspark.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/x y", "<p>one</p>"), (2, None, "<p>two ü 中</p>"), (3, "http://b/\r\nX: y", "<p>one</p>"), (4, "http://c", None), (5, "http://d", ""),
    (7, "http://e", "z" * 700_000), (6, "http://f", "z" * 700_000), (8, "", "WARC/1.1\r\n\r\nHTTP/1.1\r\n\r\n\r\n\r\n"), (None, "http://n", "<p>one</p>"), (None, None, "alone"),
    (9, "http://g", "\x00\x01"), (9, "http://g", "\x00\x01"), (9, "http://g", "another of this id"), (10, "u", "<p>short</p>"),
]


def plain(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        again = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES * 3 + [(100 + i, f"http://h/{i}", f"<p>{i % 40} " + "words " * (i % 300)) for i in range(500)], SCHEMA).repartition(3)


def test_round_trip(spark, pages, tmp_path):
    of = [tuple(r) for r in pages.collect()]
    path = str(tmp_path / "a")
    index = warc.bundle(pages, path, frame=20_000)
    assert index.count() == len(of)
    got = warc.read(spark, path).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == plain(of)
    text = collections.Counter((i, u, (h or "").encode()) for i, u, h in of)
    for r in got:
        if r["record_type"] == "response":
            assert text[(r["page_id"], r["url"], bytes(r["payload"]))]
        else:
            assert r["payload"] is None
    assert rows(warc.archive(pages)) == plain(of)
    # a small payload is never looked up
    path = str(tmp_path / "b")
    warc.bundle(pages, path, least=11)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path, payload=False).collect()], key=str) == plain(of, 11)


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    places = warc.bundle(pages, path).collect()
    names = os.listdir(f"{path}/bundles")
    assert {p["bundle"] for p in places} == {n for n in names if n.endswith(".zst")}
    for n in {p["bundle"] for p in places}:
        data = open(f"{path}/bundles/{n}", "rb").read()
        assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        frames = warc.Frames(f"{path}/bundles/{n}")
        assert b"".join(frames[k] for k in range(len(frames.sizes))) == whole
        assert len(list(warc.records(whole))) == sum(p["bundle"] == n for p in places)
        for p in [p for p in places if p["bundle"] == n][::17]:
            assert frames[p["frame"]][p["place"] : p["place"] + p["length"]].startswith(b"WARC/1.1\r\n")
        frames.close()


def test_small_bundles(spark, pages, tmp_path):
    small = pages.filter("page_id < 120")
    path = str(tmp_path / "a")
    assert warc.bundle(small, path, frame=1, size=1).select("bundle").distinct().count() > 3
    assert warc.read(spark, path).count() == small.count()


def test_lookup(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.bundle(pages, path)
    want = [3, 7, 4, 150, 555, 9, -1]
    got = warc.lookup(spark, path, spark.createDataFrame([(i,) for i in [*want, 3]], "page_id long")).collect()
    of = [r for r in pages.collect() if r["page_id"] in want]
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == sorted((r["page_id"], (r["html"] or "").encode()) for r in of)
    assert {r["url"] for r in got} == {r["url"] for r in of}


def test_lost_attempts_are_ignored(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.bundle(pages, path)
    stray = warc.Bundle(f"{path}/bundles")
    stray.add(warc.record_bytes(warc.Record(1, "u", "response", None, "A" * 32, 1, b"x")))
    stray.out.close()  # without a seek table, as of a task that was lost
    assert warc.read(spark, path).count() == pages.count()


def test_broken_payload_is_an_error(spark):
    r = warc.record_bytes(warc.Record(1, "u", "response", None, "A" * 32, 1, b"x"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(r))


def test_empty_tables_other_ids_and_clashing_columns(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 AS digest", "'x' AS first", "2 AS payload", "3 AS bundle")
    assert rows(warc.archive(df)) == plain(PAGES)
    named = [(f"p{i}", u, h) for i, u, h in PAGES if i is not None]
    assert rows(warc.archive(spark.createDataFrame(named, "page_id string, url string, html string"))) == plain(named)
    with pytest.raises(TypeError):
        warc.archive(spark.createDataFrame([(1.5, "u", "h")], "page_id double, url string, html string"))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    df = QUERIES["op12_warc"](spark, sf)
    assert rows(df) == sorted(duck.sql(ORACLE["op12_warc"]).select(*df.columns).fetchall(), key=str)
