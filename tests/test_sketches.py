"""Distribution states: any chunking stays within the stated error, and a stream's states describe all it read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import sketches as S
from foldspark.streaming import distributions as D


def frame(spark, n=20_000, seed=0):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.2, np.round(rng.normal(5, 1, n)), rng.lognormal(0, 2, n))
    return x, spark.createDataFrame([(i, ["a", "b"][i % 2], float(v)) for i, v in enumerate(x)], "i long, g string, x double")


def test_any_chunking_is_within_the_error(spark):
    x, df = frame(spark)
    for chunks in (1, 7, 40):
        parts = S.states(df.withColumn("chunk", F.col("i") % chunks), ["g", "chunk"], "x")
        got = {r["g"]: r for r in S.describe(S.merge(parts.drop("chunk"), ["g"]), ["g"]).collect()}
        for k, g in enumerate("ab"):
            v = x[k::2]
            r = got[g]
            assert r["n"] == len(v) and r["min"] == v.min() and r["max"] == v.max() and r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(ddof=1))
            for q in S.QUARTILES:
                at = r[f"q{round(100 * q)}"]
                assert (v < at).mean() - S.rank_error() <= q <= (v <= at).mean() + S.rank_error()


def test_distance_from_states_alone(spark):
    x, df = frame(spark)
    sample = df.filter("x > 0.5 OR i % 3 = 0")
    r = S.ks(S.merge(S.states(sample, [], "x"), []), S.merge(S.states(df, [], "x"), []), []).first()
    y = np.array([v["x"] for v in sample.select("x").collect()])
    at = np.unique(x)
    exact = np.abs(np.searchsorted(np.sort(y), at, "right") / len(y) - np.searchsorted(np.sort(x), at, "right") / len(x)).max()
    assert abs(r["ks"] - exact) <= r["error"] < 0.02 and r["n"] == len(y) and r["m"] == len(x)
    same = S.ks(S.states(df, ["g"], "x"), S.states(df, ["g"], "x"), ["g"]).collect()
    assert all(v["ks"] <= v["error"] for v in same)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None)], "g string, x double")
    r = S.describe(S.states(df, ["g"], "x"), ["g"]).collect()
    assert [(v["g"], v["n"], v["std"], v["q50"]) for v in r] == [("a", 1, None, 1.0)]
    assert S.merge(S.states(df.limit(0), ["g"], "x"), ["g"]).count() == 0


def test_states_of_a_stream(spark, tmp_path):
    _, df = frame(spark, 3000)
    for k in range(3):
        df.filter(F.col("i") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        D.start(stream, ["g"], "x", str(tmp_path / "states"), str(tmp_path / "check"), availableNow=True).awaitTermination()
        got = D.current(spark, str(tmp_path / "states"), ["g"])
        assert {r["g"]: r["n"] for r in got.collect()} == {r["g"]: r["n"] for r in df.filter(F.col("i") % 3 <= k).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert spark.read.parquet(str(tmp_path / "states")).select("batch").distinct().count() == 3
    for a, b in zip(S.describe(got, ["g"]).sort("g").collect(), S.describe(S.states(df, ["g"], "x"), ["g"]).sort("g").collect(), strict=True):
        assert a["mean"] == pytest.approx(b["mean"]) and a["max"] == b["max"]
