from pyspark.sql import functions as F

from plumbline import functions as fx
from plumbline.functions import fixed


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_blank_to_null(spark):
    for value, want in ((" a ", "a"), ("-", None), ("  ", None), (None, None), ("--", "--")):
        assert one(spark, value, fx.blank_to_null) == want


def test_title_case_breaks_at_delimiters(spark):
    assert one(spark, "e-commerce STORE", fx.title_case) == "E-Commerce Store"


def test_half_up_rounding(spark):
    assert one(spark, 2.675, lambda c: fx.exact_round(c, 2), "double") == 2.68


def test_guarded_int(spark):
    for value, want in (("12", 12), ("abc", 0), ("-", 0), ("-3", 0), (None, 0), ("99999999999999999999999", 0)):
        assert one(spark, value, fx.guarded_int) == want


def test_dates(spark):
    assert str(one(spark, "8/2/2013 18:30", fx.parse_any)) == "2013-02-08 18:30:00"
    for bad in ("31/31/2013 10:00", "2013-02-08 18:30", "", None):
        assert one(spark, bad, fx.parse_any) is None


def test_email(spark):
    for value, want in (("a@b.co", True), ("x@y", False), ("", False), (None, False), (" a@b.co ", True)):
        assert one(spark, value, fx.email_ok) is want


def test_record_keeps_all_fields(spark):
    df = spark.createDataFrame([("a", None, "", "b, c", 'q"t')], "a string, b string, c string, d string, e string")
    rec = df.select(fx.rebuild_record(df.columns).alias("r")).first()["r"]
    assert rec == 'a,,,"b, c","q""t"'
    df = spark.createDataFrame([(rec,)], "r string")
    assert df.select(fx.bad_record_len("r", 5).alias("x")).first()["x"] is False
    assert df.select(fx.bad_record_len("r", 5, quoted=False).alias("x")).first()["x"] is True


def test_ratio_and_bands(spark):
    assert one(spark, 0, lambda c: fx.safe_ratio(F.lit(5), c), "int") is None
    tiers = [one(spark, v, lambda c: fx.band(c, fixed.MARGIN_TIERS, fixed.MARGIN_TIER_REST), "double") for v in (70.0, 69.9, 55.0, 40.0, 39.0, None)]
    assert tiers == ["Premium (70%+)", "Healthy (55–70%)", "Healthy (55–70%)", "Standard (40–55%)", "Low (<40%)", "Low (<40%)"]


def test_value_lists(spark):
    score = lambda c: fx.map_values(c, fixed.SUSTAINABILITY, 6)
    assert [one(spark, b, score) for b in ("Garnier", "lancome", "Redken", "Brand#1", None)] == [9, 8, 7, 6, 6]
    assert one(spark, "Lancôme", lambda c: fx.flag_in(c, fixed.DIGITAL_BRANDS, fold="upper")) is False
    assert one(spark, "Lancôme", lambda c: fx.flag_in(c, fixed.DIGITAL_BRANDS, fold="upper", fold_accents=True)) is True
    assert one(spark, None, lambda c: fx.flag_in(c, fixed.DIGITAL_BRANDS)) is False


def test_weighted_score_and_zero_fill(spark):
    df = spark.createDataFrame([(10, None, 4)], "clicks long, video_views long, engagements long")
    assert df.select(fx.weighted_score().alias("s")).first()["s"] == 12.0
    assert fx.zero_fill(df, ["video_views"]).first()["video_views"] == 0


def test_private_columns(spark):
    assert fx.public_columns(spark.createDataFrame([(1, 2)], "a int, _b int")) == ["a"]
