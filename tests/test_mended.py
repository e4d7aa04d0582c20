"""Cases that once failed."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import bad_record_len, guarded_int, is_count
from plumbline.operators import etl, model, quality, segment, windows
from plumbline.sources import files


def test_fields_of_any_length(spark):
    long = '"' + "x,y""" * 50_000 + '",b'
    many = ",".join('"a,""b"""' for _ in range(10_000))
    rows = spark.createDataFrame([(1, long), (2, many), (3, 'a,"b,c",,"d""e" ,"'), (4, ""), (5, None), (6, 'a"b,c')], "i int, line string")
    got = {r.i: r for r in rows.select("i", files.field_count("line").alias("n"), files.split_fields("line").alias("f"), bad_record_len("line", 2).alias("bad")).collect()}
    assert got[1].n == 2 and got[1].f == ["x,y" * 50_000, "b"] and not got[1].bad
    assert got[2].n == 10_000 and set(got[2].f) == {'a,"b"'} and len(got[2].f) == 10_000
    assert got[3].n == 5 and got[3].f[:4] == ["a", "b,c", "", 'd"e']
    assert got[4].f == [""] and got[5].f is None and got[5].n is None
    assert got[6].n == 1 and len(got[6].f) == 1


def test_other_separators(spark):
    row = spark.createDataFrame([('a|"b|c"|d;e',)], "line string").select(files.split_fields("line", "|").alias("f"), files.field_count("line", "|").alias("n")).first()
    assert row.f == ["a", "b|c", "d;e"] and row.n == 3


def test_row_security_folds_both_sides(spark):
    rows = spark.createDataFrame([("mx", 1), (" PE", 2)], "countrycode string, v int")
    mapping = spark.createDataFrame([("Ana@Corp.com ", "ALL"), (" bob@corp.COM", "pe")], "useremail string, countrycode string")
    assert model.apply_rls(rows, mapping, " ana@corp.com").count() == 2
    assert [r.v for r in model.apply_rls(rows, mapping, "BOB@corp.com").collect()] == [2]
    assert model.apply_rls(rows, mapping, "eve@corp.com").count() == 0


def test_entities_with_missing_parts_stay_apart(spark):
    rows = spark.createDataFrame([(None, "x"), ("x", None), ("a | b", "c"), ("a", "b | c"), ("\\N", "x"), ("a", "b")], "p string, q string")
    names = [r.n for r in rows.select(segment.entity_name(["p", "q"]).alias("n")).collect()]
    assert len(set(names)) == 6 and names[-1] == "a | b"


@pytest.mark.parametrize("keep_nulls", [True, False])
def test_upsert_is_associative(spark, keep_nulls):
    rows = [("k", "A", 1), ("k", "B", 2), ("k", None, 3)]
    part = lambda *i: spark.createDataFrame([rows[j] for j in i], "key string, v string, seq long")
    merge = lambda t, b: etl.upsert(t, b, ["key"], {"v": "last"}, ["seq"], keep_nulls)
    want = None if keep_nulls else "B"
    for target, batch in ((None, part(0, 1, 2)), (merge(None, part(0, 2)), part(1)), (merge(None, part(1)), merge(None, part(0, 2))), (merge(None, part(2, 1)), part(0))):
        assert merge(target, batch).first().v == want


@pytest.mark.parametrize("rows", [[], [(None,), (None,)]])
def test_statistics_of_nothing(spark, rows):
    got = quality.value_stats(spark.createDataFrame(rows, "v double"), "v").collect()
    assert len(got) == 1 and set(got[0]) == {None}


def test_overlong_counters_are_not_numbers(spark):
    row = spark.createDataFrame([("9" * 20, " 12 ")], "a string, b string").select(guarded_int("a"), is_count("a"), guarded_int("b"), is_count("b")).first()
    assert list(row) == [0, False, 12, True]


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.lit(1.0).alias("v"))
    shares = windows.add_share(rows, "v", "k", "share")
    assert shares.where("k = 'hot'").agg(F.count("*"), F.max("share")).first()[0] == 18_000 and shares.where("k <> 'hot'").agg(F.min("share")).first()[0] == 100
    assert quality.repeated_entities(rows, "k").count() == 18_000
    parents = spark.createDataFrame([("hot",), ("hot",)], "k string")
    assert quality.missing_parent(rows, parents, ["k"]).count() == 2_000 and quality.split_by_existence(rows, parents, ["k"]).count() == 20_000


def test_whole_audit_leaves_no_column_dimension_or_rule_out(spark):
    import __spark_entry__ as entry
    from plumbline.plans import star
    from plumbline.plans.standins import World

    found = {(r["check"], r.scope): r.value for r in entry.queries()["audit_of_the_whole_star"](spark, "/root/testdata/sf0.001").collect()}
    scopes = lambda check: {s for c, s in found if c == check}
    assert scopes("nulls") == set(World(spark, "/root/testdata/sf0.001").fact.columns)
    assert scopes("row_count") == scopes("duplicate") == {"fact", "product", "geography", "channel", "segment", "dates"}
    assert scopes("orphan") == {f"orphan {k}" for k in ("productkey", "geokey", "channelkey", "segmentkey", "date")} and all(found["orphan", s] for s in scopes("orphan"))
    assert scopes("range") == set(star._RANGES)
