"""Star and snowflake modelling, the enriched view and row-level security."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import band, exact_round, fixed, flag_in, map_values
from .windows import dedup_first, surrogate_key


def margin_bands(df: DataFrame, margin: str = "margin_pct", revenue: str = "revenue_usd") -> DataFrame:
    return df.withColumns({
        "margin_tier": band(margin, fixed.MARGIN_TIERS, fixed.MARGIN_TIER_REST),
        "revenue_bucket": band(revenue, fixed.REVENUE_BUCKETS, fixed.REVENUE_BUCKET_REST),
    })


def clean_fact(fact: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First row per transaction, with its margin and revenue bands."""
    return margin_bands(dedup_first(fact, [key], order))


def enriched(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Inner-join every dimension: ``{key column: (frame, columns to take)}``.
    Statistics decide which side is broadcast."""
    out = fact
    for key, (dim, cols) in dims.items():
        out = out.join(dim.select(key, *cols), key)
    return out


def brand_dim(product: DataFrame, fold_accents: bool = False) -> DataFrame:
    """One row per brand and division with its planning attributes."""
    brands = product.select("brand", "division").where("brand IS NOT NULL").distinct()
    keyed = surrogate_key(brands, ["brand", "division"], "brand_id")
    fold = {"fold": "upper", "fold_accents": fold_accents}
    return keyed.select(
        "brand_id", F.col("brand").alias("brand_name"), "division",
        map_values("division", fixed.BRAND_TIERS, "Mass", **fold).alias("brand_tier"),
        flag_in("division", fixed.LUXURY_DIVISIONS, **fold).alias("is_luxury"),
        flag_in("brand", fixed.DIGITAL_BRANDS, **fold).alias("digital_priority"),
        map_values("brand", fixed.SUSTAINABILITY, 6, **fold).alias("sustainability_score"),
        map_values("brand", fixed.LAUNCH_YEARS, 2005, **fold).alias("latam_launch_year"),
    )


def category_dim(product: DataFrame) -> DataFrame:
    """One row per category and subcategory; a missing subcategory takes the
    category's name."""
    pairs = product.select("category", "subcategory").where("category IS NOT NULL").distinct()
    keyed = surrogate_key(pairs, ["category", F.asc_nulls_first("subcategory")], "category_id")
    return keyed.select(
        "category_id", F.col("category").alias("category_name"),
        F.coalesce("subcategory", "category").alias("subcategory_name"),
        map_values("category", fixed.GROWTH_PRIORITY, "Low", fold="lower").alias("growth_priority"),
        flag_in("category", fixed.DIGITAL_CATEGORIES).alias("is_digital_first"),
        flag_in("category", fixed.DIGITAL_FIRST_CATEGORIES).alias("sold_online_first"),
        map_values("category", fixed.MARGIN_PROFILE, "Medium", fold="lower").alias("margin_profile"),
    )


def build_slim(product: DataFrame, brand: DataFrame, category: DataFrame, fold: bool = False) -> DataFrame:
    """Product table that refers to brand and category by key. ``fold`` matches
    names regardless of case and surrounding blanks. If a brand name occurs with
    two divisions the product fans out; ``preserves_rows`` shows it."""
    key = (lambda c: F.upper(F.trim(c))) if fold else (lambda c: c)
    p = product.withColumns({
        "_b": key(F.col("brand")), "_c": key(F.col("category")),
        "_s": key(F.coalesce("subcategory", "category")),
    })
    b = brand.select("brand_id", key(F.col("brand_name")).alias("_b"))
    c = category.select("category_id", key(F.col("category_name")).alias("_c"),
                        key(F.col("subcategory_name")).alias("_s"))
    return p.join(b, "_b", "left").join(c, ["_c", "_s"], "left").select(
        "productkey", "product_name", "brand_id", "category_id",
        F.col("brand").alias("brand_name_ref"), F.col("category").alias("category_name_ref"))


def snowflake_join(fact: DataFrame, slim: DataFrame, brand: DataFrame, category: DataFrame) -> DataFrame:
    """Fact to product to brand and category. The product side is resolved first:
    it is far smaller than the fact, so the fact is joined only once."""
    product = slim.join(brand, "brand_id").join(category, "category_id")
    return fact.join(product, "productkey")


def revenue_by(df: DataFrame, by: Sequence[str], key: str, key_alias: str, score: str | None = None) -> DataFrame:
    """Revenue per group with the number of distinct members behind it. Rows are
    first summed per member, which removes the expensive distinct."""
    aggs = [F.sum("revenue_usd").alias("_rev"), F.count(F.lit(1)).alias("_n")]
    per_member = df.groupBy(*by, key, *([score] if score else [])).agg(*aggs)
    out = [F.count(F.lit(1)).alias(key_alias), exact_round(F.sum("_rev"), 2).alias("total_revenue")]
    if score:
        weighted = F.sum(F.col(score) * F.col("_n")).cast("double") / F.sum("_n")
        out.append(exact_round(weighted, 1).alias(f"avg_{score}"))
    return per_member.groupBy(*by).agg(*out)


def apply_rls(df: DataFrame, mapping: DataFrame, user: str, code: str = "countrycode") -> DataFrame:
    """Rows a user may see. The user's codes are a handful of rows; ``ALL`` opens
    everything through a scalar subquery, so no join condition has an OR."""
    codes = mapping.filter(F.lower(F.trim("useremail")) == F.lower(F.trim(F.lit(user)))).select(
        F.upper(F.trim("countrycode")).alias("_code"))
    sees_all = codes.agg(F.coalesce(F.bool_or(F.col("_code") == "ALL"), F.lit(False)).alias("x")).scalar()
    own = codes.distinct().withColumn("_mine", F.lit(True))
    return (
        df.join(own, F.upper(F.trim(code)) == F.col("_code"), "left")
        .filter(sees_all | F.col("_mine")).select(*df.columns)
    )
