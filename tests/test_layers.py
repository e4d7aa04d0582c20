"""Queries that read a few columns of the load, against the same taken from its work table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.operators import monitor, rules, windows
from plumbline.plans import campaign, loads, monitoring
from plumbline.plans.standins import World

KINDS = ("view", "click", "purchase", "error", "signup")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Few addresses, so that sends repeat, some rows twice and some without a time."""
    root = tmp_path_factory.mktemp("events")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 211 == 0 else start + dt.timedelta(minutes=31 * i % 40_000), i % 6, KINDS[i % 5 if i % 3 else 0], float(i % 90)) for i in range(1_500)]
    spark.createDataFrame(rows + rows[:50], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(f"{root}/events.parquet")
    return str(root)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _wanted(name, x):
    if name == "file_list":
        return monitor.list_files(x.files, x.stats, x.incidents)
    if name == "target_assertions":
        return monitor.assertions(x.stats, x.visits, x.visitors, x.files.filter("file_id > 30"))
    if name == "ruling_summary":
        return monitor.ruling_summary(monitor.register_rulings(x.rulings, x.stats)[0])
    found = rules.apply_rules(rules.with_repetition(x.ranked), rules.br_repetition_rules(), ["file_id", "line_no"])
    return found.groupBy("codigo_error", "severidad").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


@pytest.mark.parametrize("name", ["file_list", "ruling_summary", "business_rules_of_repetition", "target_assertions"])
def test_no_work_table_for_a_few_columns(spark, folder, monkeypatch, name):
    want = _rows(_wanted(name, World(spark, folder)))
    monkeypatch.setattr(World, "ranked", property(lambda self: pytest.fail("the whole work table is ranked and written")))
    assert want and _rows(getattr(campaign if hasattr(campaign, name) else monitoring, name)(World(spark, folder))) == want


def test_rejections_are_those_of_the_ranked_rows(spark, folder):
    x = World(spark, folder)
    all_of_them = rules.record_incidents(x.ranked, x.LINEAGE).filter(F.col("severidad") == fixed.REJECT)
    assert _rows(rules.rejections(x.work, x.LINEAGE)) == _rows(all_of_them) != []


def test_wide_projections_are_compiled_in_any_session(spark, folder):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, kept in (("65535", "8000"), ("500", "500")):
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", given)
            World(spark, folder)
            assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == kept
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_copies_of_files_are_dealt_from_one_row(spark, folder):
    lines = loads._lines(World(spark, folder))
    # once for the records, once for the heads of files
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    of = {(r.box, r.file[0]): r.n for r in lines.where("box IS NOT NULL").groupBy("box", F.left("file", F.lit(1)).alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(of) == {(0, "a"), (1, "a"), (1, "b")}
    name = F.substring("file", 2, 100)
    first, copy = (lines.where((F.col("box") == b) & F.col("file").startswith(k)).select(name.alias("n"), "line_no", "value") for b, k in ((0, "a"), (1, "b")))
    assert copy.exceptAll(first).isEmpty() and first.where((F.substring("n", 1, 14).cast("long") % 7) == 1).exceptAll(copy).isEmpty()


def test_only_later_pieces_are_looked_up(spark):
    rows = spark.createDataFrame([("a", 9, 1), ("a", 9, 2), ("a", 5, 3), ("a", 1, 4), ("b", 5, 5), (None, 5, 6)], "k string, v int, line int")
    ranked = windows.rank_best(rows, ["k"], [F.desc("v"), F.desc("line")], coarse=[-F.col("v")])
    assert {r.line: r.rn for r in ranked.collect()} == {2: 1, 1: 2, 3: 3, 4: 4, 5: 1, 6: None}
    assert "isnotnull(_before" in ranked._jdf.queryExecution().analyzed().toString()
