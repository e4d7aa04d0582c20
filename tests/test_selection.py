"""Selection, permutation, seeding, sketches and marts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, segment as sg
from plumbline.operators.selection import quantiles
from plumbline.sources import tables


@pytest.mark.parametrize("interpolate", [True, False])
def test_percentiles_of_all_groups(spark, interpolate):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v), float(i)) for i, v in enumerate(rng.normal(size=3000))] + [("tied", 1.0, 2.0)] * 50 + [("one", 5.0, None), ("none", None, None), (None, 7.0, 1.0), (None, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(6)
    got = {r.g: r for r in quantiles(df, ["g"], {"low": ("v", 0.1), "mid": ("v", 0.5), "top": ("w", 1.0)}, interpolate).collect()}
    assert set(got) == {"hot", "tied", "one", "none", None}
    for g in got:
        for name, column, p in (("low", 1, 0.1), ("mid", 1, 0.5), ("top", 2, 1.0)):
            values = sorted(r[column] for r in rows if r[0] == g and r[column] is not None)
            want = None if not values else float(np.quantile(values, p, method="linear" if interpolate else "inverted_cdf"))
            assert got[g][name] == (want if want is None else pytest.approx(want, abs=1e-12))
    assert quantiles(df.limit(0), ["g"], {"m": ("v", 0.5)}).collect() == []
    assert quantiles(df.limit(0), [], {"m": ("v", 0.5)}).first().m is None


def test_a_hot_group_lies_in_many_tasks(spark, monkeypatch):
    from plumbline.operators import selection
    seen = []
    write = selection.write_once
    monkeypatch.setattr(selection, "write_once", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), F.hash("id").cast("double").alias("v"))
        quantiles(df, ["g"], {"m": ("v", 0.5)}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    parts = dict(seen)["value-counts"].groupBy("s").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 8_000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 5000, 65_537])
def test_the_permutation_is_one(n):
    got = sg.permuted_ids(np.arange(n), n, [11, 22, 33, 44])
    assert sorted(got.tolist()) == list(range(n))
    if n > 90:
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.3 and (got != sg.permuted_ids(np.arange(n), n, [1, 2, 3, 4])).any()


def test_a_small_far_group_gets_a_start(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20_000, 2)), rng.normal(size=(20, 2)) * 0.1 + 60])
    points = spark.createDataFrame([("real", str(i), v.tolist()) for i, v in enumerate(x)] + [("same", str(i), [1.0, 1.0]) for i in range(9)], "source string, pid string, x array<double>").repartition(5)
    found = sg.oversampled(points, 4, seed=3)
    centres, weight = found["real"]
    assert len(centres) <= sg.PASSES * sg.OVERSAMPLED * 4 and weight.sum() == 20_020
    far = centres[:, 0] > 50
    assert far.any() and weight[far].sum() == 20
    assert found["same"][0].tolist()[0] == [1.0, 1.0] and found["same"][1].sum() == 9
    rng = np.random.default_rng(1)
    assert sum((sg._seed_centres(centres, weight, 2, rng)[:, 0] > 50).sum() == 1 for _ in range(sg.STARTS)) > sg.STARTS // 2


def test_sketches_rule_pairs_out(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("a"), (F.col("id") % 900).alias("b"), F.floor(F.col("id") / 4).alias("c"), (F.col("id") % 1000).alias("d"))
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    exact = {p: df.select(*p).distinct().count() for p in pairs}
    kept = profile.likely_pairs(df, pairs, 0.9)
    assert set(kept) == {p for p in pairs if exact[p] > 0.9 * 4000} and ("a", "d") not in kept
    found = [r["columns"] for r in profile.key_candidates(df).collect()]
    assert "a + d" not in found and {" + ".join(p) for p in kept} >= {f for f in found if "+" in f}


def test_marts_join_without_a_shuffle(spark, tmp_path):
    fact = spark.range(5000).select((F.col("id") % 97).alias("k"), (F.col("id") % 50).alias("x"), (F.col("id") % 71).alias("y"))
    dim = spark.range(97).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = tables.save_mart(fact, "mart_a", ["k"], 4, str(tmp_path / "a"), ["x", "y"])
        b = tables.save_mart(dim, "mart_b", ["k"], 4, str(tmp_path / "b"))
        joined = a.join(b, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 5000
        assert "PushedFilters: [IsNotNull(x), LessThan(x,5)" in a.where("x < 5")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS mart_a")
        spark.sql("DROP TABLE IF EXISTS mart_b")
    z = spark.createDataFrame([(3, 5), (0, None)], "a int, b int").select(tables.z_value(["a", "b"], 4).alias("z")).collect()
    assert [r.z for r in z] == [0b100111, 0]
