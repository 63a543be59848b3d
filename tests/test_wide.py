"""Rows of wide tables by late materialisation against a semi-join."""

import pytest
from pyspark.sql import functions as F

from foldspark.sources import tables, wide

N, WIDTH = 4000, 2381


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """2,384 columns, several files, small row groups."""
    path = str(tmp_path_factory.mktemp("wide") / "t")
    df = spark.range(N).select("id", *[(F.col("id") * i % 997).cast("float").alias(f"F{i}") for i in range(1, WIDTH + 1)], F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), "id")).alias("sha256"), F.array(F.col("id"), F.lit(None)).alias("list"))
    df.repartitionByRange(4, "id").write.option("parquet.block.size", 2 << 20).option("parquet.page.row.count.limit", 100).parquet(path)
    return path


def test_equal_to_the_semi_join(spark, table):
    keys = spark.createDataFrame([(i,) for i in [5, 5, 1999, 2000, 3999, -1, 10**9, *range(700, 760)]], "id long")
    want = spark.read.parquet(table).join(keys.distinct(), "id", "left_semi")
    got = wide.gather(spark, table, keys, "id")
    assert got.schema == spark.read.parquet(table).schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 64
    some = wide.gather(spark, table, keys, "id", ["F7", "list", "id"], span=10)
    assert some.columns == ["F7", "list", "id"] and sorted(map(str, some.collect())) == sorted(map(str, want.select("F7", "list", "id").collect()))
    assert wide.gather(spark, table, keys.filter("id < 0"), "id").count() == 0
    named = spark.createDataFrame([("s1",), ("s2",), (None,)], "sha256 string")  # null picks nothing
    assert {r["id"] for r in wide.gather(spark, table, named, "sha256", ["id"]).collect()} == {1, 2}


def test_bytes_follow_the_selection(spark, table):
    read = lambda keys: wide.gather(spark, table, keys, "id", count=True).agg(F.sum("rows"), F.sum("bytes")).first()
    all_ = read(spark.range(N))
    few = read(spark.range(40))
    assert all_[0] == N and few[0] == 40 and few[1] < all_[1] / 3
    plan = wide.places(spark, table, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,_tmp_metadata_row_index:bigint>" in plan  # keys are found without the wide columns


def test_positions_need_no_sort(spark, table):
    p = wide.positions(spark, table, ["id"])
    got = p.collect()
    assert sorted(r["position"] for r in got) == list(range(N))
    ids = [r["id"] for r in sorted(got, key=lambda r: r["position"])]
    assert len(set(ids)) == N and sum(b != a + 1 for a, b in zip(ids, ids[1:], strict=False)) < 8  # in order within files
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_subset_writes_and_counts(spark, table, tmp_path):
    keys = spark.range(0, N, 50)
    got = tables.write_subset(spark.read.parquet(table).select("id", "F1"), keys, "id", str(tmp_path / "s"))
    assert got == {"rows": N, "asked": 80, "written": 80}
