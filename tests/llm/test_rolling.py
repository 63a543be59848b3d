"""Rolling medians against a plain version, on ties, nulls, broken values, repeated ids, one hot instant and long gaps."""

import datetime
import math
import random

import duckdb
import pyarrow as pa
import pytest

from foldspark.llm import rolling
from foldspark.llm.oracles import ORACLE
from foldspark.llm.queries import QUERIES

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"
EPOCH = datetime.datetime(1970, 1, 1)


def plain_cents(v):
    return None if v is None or math.isnan(v) or abs(v * 100) >= 2.0**53 else math.floor(100 * v + 0.5)


def twice_median(x):
    x = sorted(x)
    return x[(len(x) - 1) // 2] + x[len(x) // 2]


def plain(rows, length=rolling.LENGTH):
    first = {}
    rank = lambda r: tuple((x is not None, x) if x is not None else (False,) for x in (r[2], r[1], r[3], r[4]))
    for r in rows:
        if r[0] not in first or rank(r) < rank(first[r[0]]):
            first[r[0]] = r
    left = [(i, (ts - EPOCH) // datetime.timedelta(microseconds=1), kind, plain_cents(v)) for i, ts, _, kind, v in first.values() if ts is not None]
    out = []
    for i, us, kind, c in left:
        x = [d for _, u, k, d in left if k == kind and us - length < u <= us and d is not None]
        m = twice_median(x) if x else None
        mad = twice_median([abs(2 * d - m) for d in x]) if x else None
        out.append((i, kind, len(x), m, mad, None if c is None else 2 * abs(2 * c - m) > 2 * mad))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n, seed, span, values, kinds=("view", "click", None)):
    rng = random.Random(seed)
    base = datetime.datetime(2024, 3, 10, 1, 50)
    return [(i, base + datetime.timedelta(microseconds=rng.choice(span) * rng.randint(0, 1000)), base, rng.choice(kinds), rng.choice(values)(rng)) for i in range(n)]


ODD = [lambda r: None, lambda r: r.expovariate(1 / 50), lambda r: -1.005, lambda r: float("nan"), lambda r: float("inf"), lambda r: 1e300, lambda r: r.randint(0, 3) / 4, lambda r: r.uniform(-1e7, 1e7)]


@pytest.mark.parametrize("rows", [
    made(700, 1, [3_000_000, 10_000_000], ODD),
    made(400, 2, [1, 900_000], ODD[1:2] + ODD[6:]),  # edges at exact microseconds
    made(300, 3, [0], ODD),  # one instant
    made(200, 4, [10**9], ODD),  # gaps, windows of one
])
def test_against_plain(spark, rows):
    rows = rows + rows[::7] + [(None, *rows[0][1:]), (None, *rows[1][1:]), (10**6, None, rows[0][2], "view", 1.0)]
    rows += [(5, rows[5][1] + datetime.timedelta(minutes=3), rows[5][2] - datetime.timedelta(days=1), "click", 7.0)]  # another row of an id, which arrived first
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(rolling.rolling(df)) == plain(rows)


def test_small_slabs_edges_and_panes(spark, monkeypatch):
    """Blocks that span batches, chunks of few queries, and many panes give the same."""
    import foldspark.llm.rolling as R

    rows = made(900, 9, [500_000], ODD[:2] + ODD[6:])
    table = pa.table({"series": [r[3] for r in rows], "us": [(r[1] - EPOCH) // datetime.timedelta(microseconds=1) for r in rows], "value": pa.array([plain_cents(r[4]) for r in rows], pa.int64()), "times": [1 + i % 3 for i in range(len(rows))]})
    both = []
    for add in (0, 1):
        b = [x // rolling.LENGTH + add for x in table.column("us").to_pylist()]
        both.append(table.append_column("block", pa.array(b)))
    t = pa.concat_tables(both).sort_by([("series", "ascending"), ("block", "ascending")])
    want = None
    for slab, edges, pane in ((1 << 17, 1 << 20, 6), (50, 100, 1), (1, 1, 0.3)):
        monkeypatch.setattr(R, "SLAB", slab)
        monkeypatch.setattr(R, "EDGES", edges)
        monkeypatch.setattr(R, "PANE", pane)
        got = pa.concat_tables([R.medians(x, R.LENGTH) for x in R.whole_blocks(iter(t.to_batches(max_chunksize=64)))])
        got = sorted(map(str, got.to_pylist()))
        assert want is None or got == want
        want = got
    assert len(want) == len({(r[3], r[1]) for r in rows})


def test_zones_empty_tables_and_clashing_columns(spark):
    rows = made(150, 5, [20_000_000], ODD[:2])
    df = spark.createDataFrame(rows, SCHEMA)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:  # an hour that this zone leaves out
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert result(rolling.rolling(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    odd = df.selectExpr("*", "1 AS series", "'x' AS us", "2 AS n", "3 AS row", "4 AS block", "5 AS at", "6 AS cents")
    assert result(rolling.rolling(odd)) == plain(rows)
    assert result(rolling.rolling(df.selectExpr("click_id", "CAST(ts AS TIMESTAMP) AS ts", "arrived_at", "kind", "value"))) == plain(rows)
    none = rolling.rolling(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["click_id", "kind", "n", "median2", "mad4", "far"]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view clicks as select * from '{sf}/clicks.parquet'")
    df = QUERIES["op13_rolling_median"](spark, sf)
    assert result(df) == sorted(duck.sql(ORACLE["op13_rolling_median"]).select(*df.columns).fetchall(), key=str)
