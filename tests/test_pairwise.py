"""Pairs by blocks: every pair once, and rows sent a fixed number of times."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark.operators import geometry as G
from foldspark.operators import kernels as K
from foldspark.operators import pairwise as P


def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    own = x["_block"].iloc[0] == y["_block"].iloc[0]
    keep = x["i"].to_numpy()[:, None] < y["i"].to_numpy() if own else np.ones((len(x), len(y)), bool)
    return pd.DataFrame({"n": [int(keep.sum())], "s": [float(((x["i"].to_numpy()[:, None] + y["i"].to_numpy()) * keep).sum())]})


@pytest.mark.parametrize("n", [0, 1, 700, 3000])
def test_every_pair_once(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "i")
    got = P.pairs(rows, rows, "i", met, "n long, s double", symmetric=True, block=64).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    assert tuple(got) == (n * (n - 1) // 2, n * (n - 1) ** 2 / 2)


def test_rows_are_sent_a_fixed_number_of_times(spark):
    n = 40_000
    rows = spark.range(n).withColumnRenamed("id", "i")
    assert P.blocks(rows, "i")[1] == P.BLOCKS
    assert P.pairs(rows, rows, "i", met, "n long, s double", symmetric=True).agg(F.sum("n")).first()[0] == n * (n - 1) // 2


def test_gram_tables_take_each_kernel_once(spark):
    x = np.random.default_rng(0).normal(size=(150, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    kernel = lambda a, b: a @ b.T
    got = {(r["i"], r["j"]): r["k"] for r in K.gram_upper(rows, kernel, block=32, mirrored=True).collect()}
    assert len(got) == 150 * 149 and all(got[i, j] == got[j, i] == pytest.approx(x[i] @ x[j]) for i, j in got)
    rect = K.gram(rows.filter("i % 4 <> 0"), rows.filter("i % 4 = 0"), kernel, block=16).collect()
    assert {(r["i"], r["j"]) for r in rect} == {(i, j) for i in range(150) if i % 4 for j in range(0, 150, 4)} and len(rect) == 112 * 38
    assert all(r["k"] == pytest.approx(x[r["i"]] @ x[r["j"]]) for r in rect)


def test_mirrored_halves_are_written_as_copies(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1200, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    kernel = lambda a, b: np.random.default_rng(len(a)).random((len(a), len(b)))
    sizes = []
    for name, mirrored in (("half", False), ("both", True)):
        K.gram_upper(rows, kernel, block=64, mirrored=mirrored).coalesce(1).write.parquet(str(tmp_path / name))
        sizes.append(sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")))
    both = spark.read.parquet(str(tmp_path / "both"))
    assert both.count() == both.select("i", "j").distinct().count() == 1200 * 1199
    assert sizes[1] < 1.5 * sizes[0]


def test_gram_sym_sends_vectors_as_stored(spark):
    from foldspark.plans.kernels import stored

    assert dict(stored(spark, "/root/testdata/sf0.001").dtypes) == {"i": "bigint", "x": "array<float>"}


def test_gram_rect_sends_vectors_as_stored(spark):
    from foldspark.plans.kernels import gram_rect

    assert "transform(" not in gram_rect(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_silhouette_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    y = np.append(rng.integers(0, 3, 1299), 7)
    x = rng.normal(size=(1300, 9)) + 3 * y[:, None]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    sums = np.stack([d[:, y == c].sum(1) for c in np.unique(y)], 1)
    n, own = np.array([(y == c).sum() for c in np.unique(y)]), np.unique(y)[None] == y[:, None]
    a, b = (sums * own).sum(1) / np.maximum((own * n).sum(1) - 1, 1), np.where(own, np.inf, sums / n).min(1)
    want = np.where((own * n).sum(1) > 1, (b - a) / np.maximum(a, b), 0).mean()
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "i long, x array<double>, y int")
    assert G.silhouette(df, "i", "x", "y").first()[0] == pytest.approx(want, abs=1e-9)
