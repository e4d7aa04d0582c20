import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.operators import segment as sg


def planted(spark, centres, per, spread=0.15, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(f"e{i:03d}_{c}", *[float(v) for v in np.array(m) + rng.normal(0, spread, len(m))], c) for c, m in enumerate(centres) for i in range(per)]
    return spark.createDataFrame(rows, "entity string, a double, b double, c double, _truth int")


F3 = ["a", "b", "c"]
Z3 = [f"{f}_z" for f in F3]


def test_planted_groups_are_found(spark):
    df = sg.standardize(planted(spark, [(0, 0, 0), (3, 3, 0), (0, 3, 3)], 30), F3)
    verdict = sg.structure_verdict(sg.sweep_k(df, Z3, "entity", k_max=5, n_null=2, starts=4)).first()
    assert verdict["structure"] == "clara" and verdict["best_k"] == 3 and verdict["best_silhouette"] > 0.7
    fitted = sg.fit_segments(df, Z3, 3)
    assert sg.adjusted_rand(fitted, "cluster", "_truth").first()["adjusted_rand"] == 1.0


def test_noise_is_not_structure(spark):
    """Silhouette alone would be fooled; the gap to the shuffled data is not."""
    steps = [(0.8191725134, 0.6710436067, 0.5497004779)[j] for j in range(3)]  # low-discrepancy cloud
    rows = [(f"e{i:03d}", *[float((0.5 + i * s) % 1) for s in steps]) for i in range(1, 141)]
    df = sg.standardize(spark.createDataFrame(rows, "entity string, a double, b double, c double"), F3)
    verdict = sg.structure_verdict(sg.sweep_k(df, Z3, "entity", n_null=3, starts=4)).first()
    assert verdict["best_silhouette"] > 0.2 and verdict["structure"] == "ninguna"


def test_wide_range_misleads_without_scaling(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", float(rng.uniform(0, 1e6)), float(rng.normal(10 * (i % 2), 0.5)), float(rng.normal(10 * (i % 2), 0.5)), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "entity string, a double, b double, c double, _truth int")
    out = {r["fit"]: r["adjusted_rand"] for r in sg.scaling_effect(df, F3, "_truth", 2).collect()}
    assert out["scaled"] > 0.85 and out["raw"] < 0.15


def test_silhouette_in_blocks_is_exact(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    label[0] = 9  # a cluster of one
    df = spark.createDataFrame([(i, *map(float, x[i]), int(label[i])) for i in range(60)], "id long, a double, b double, c double, l int")
    got = {int(r["pid"]): r["silhouette"] for r in sg.silhouette_points(df, F3, "l", "id", block=13).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(60):
        own = label == label[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_permutation_is_reproducible(spark):
    df = planted(spark, [(0, 0, 0), (3, 3, 0)], 50)
    one = sorted(map(tuple, sg.permute_columns(df, F3, "entity", 1).select("entity", *F3).collect()))
    two = sorted(map(tuple, sg.permute_columns(df.repartition(5), F3, "entity", 1).select("entity", *F3).collect()))
    other = sorted(map(tuple, sg.permute_columns(df, F3, "entity", 2).select("entity", *F3).collect()))
    assert one == two and one != other
    for i, f in enumerate(F3):
        assert sorted(r[i + 1] for r in one) == sorted(r[f] for r in df.collect())


def test_preconditions(spark):
    df = planted(spark, [(0, 0, 0)], 5)
    for features in (["a", "_truth"], ["a"], ["a", "zzz"], ["a", "entity"]):
        with pytest.raises(sg.NotAllowed):
            sg.standardize(df, features)
    with pytest.raises(sg.NotAllowed):
        sg.standardize(df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), F3)
    for check in (lambda: sg.check_entities(df), lambda: sg.check_k(13, 100, df), lambda: sg.check_k(3, 100, None), lambda: sg.check_scaled(df, F3),
                  lambda: sg.check_labelled(df), lambda: sg.check_profiled(None), lambda: sg.to_entities(df, ["_truth"], {"a": "mode"})):
        with pytest.raises(sg.NotAllowed):
            check()


def test_the_whole_path(spark):
    base = planted(spark, [(0, 0, 0), (4, 4, 4)], 15)
    rows = base.unionByName(base).withColumn("value", F.col("a") + 10)
    out = sg.segment(rows, ["entity"], {"a": "mean", "b": "mean", "value": "sum"}, ["a_mean", "b_mean"], "value_sum", k_max=4, n_null=2, starts=3)
    assert out["verdict"].first()["best_k"] == 2
    assert {r["structure"] for r in out["findings"].collect()} == {"clara"} and out["concentration"].count() == 2


def test_entities(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("y", None), (None, 2.0)], "k string, v double")
    out = {r["k"]: (r["v_sum"], r["_n_source_rows"]) for r in sg.to_entities(df, ["k"], {"v": "sum"}).collect()}
    assert out == {"x": (1.0, 2), "y": (0.0, 1), None: (2.0, 1)}


def test_points_move_to_a_bounded_number_of_blocks():
    """What moves grows with the points; only blocks too large for a task make it more."""
    assert sg._blocks(100_000, 64, 100) == sg._blocks(600_000, 64, 100) == sg.BLOCKS
    assert sg._blocks(60, 3, 13) == 5 and sg._blocks(0, 3, 100) == 1
    assert sg._blocks(10_000_000, 64, 100) * sg.NUMBERS >= 64 * 10_000_000


def test_silhouette_of_near_copies_far_from_the_origin(spark):
    """Differences far below the values, repeated keys, exact copies, and a point without a label."""
    rng = np.random.default_rng(6)
    x = 1e6 + np.repeat(rng.normal(size=(10, 3)), 4, axis=0) + np.tile([0.0, 0.0, 1e-6, 3e-6], 10)[:, None]
    label = np.arange(40) // 4 % 3
    rows = [(i, *map(float, x[i]), int(label[i])) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, 1e6, 1e6, 1e6, None)], "id long, a double, b double, c double, l int")
    got = {int(r["pid"]): r["silhouette"] for r in sg.silhouette_points(df, F3, "l", "id", block=9).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(40):
        a = d[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(d[i, label == o].mean() for o in {0, 1, 2} - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    assert got[99] == 0 and len(got) == 41


def test_sums_over_a_block_with_a_missing_feature_are_unknown(spark):
    rows = [(i, float(i), float(i % 2), 0.0, i % 2) for i in range(6)]
    df = spark.createDataFrame([*rows, (6, None, 1.0, 0.0, 1)], "id long, a double, b double, c double, l int")
    assert [r["silhouette"] for r in sg.silhouette_points(df, F3, "l", "id").collect()] == [0.0] * 7
