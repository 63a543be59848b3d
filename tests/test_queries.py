"""Every query with SQL against DuckDB on the smallest tables: columns, types and rows."""

import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
PLAIN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(table):
    clean = lambda x: round(x, 5) if isinstance(x, float) else x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x
    return sorted(str([clean(x) for x in r]) for r in table)


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    want_types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == {c: t.split("_")[0] if t.startswith("TIMESTAMP") else t for c, t in want_types.items()}
    assert rows(got) == rows(rel.select(*[f'"{c}"' for c in names]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
