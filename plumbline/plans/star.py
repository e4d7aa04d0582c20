"""Queries over the sales star: audit, cleaning, modelling, commercial measures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import kpi, model, profile, quality as q, windows as w
from ..session import scratch, write_once
from ..sources import tables
from .oracle import r, sql
from .registry import query

_TABLES = ("fact", "product", "geography", "channel", "segment", "dates", "security")


def _counts(names):
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in names)


# --- sources and sinks --------------------------------------------------------------------
@query("SELECT count(*) AS n, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations FROM customer")
def workspace_load(x):
    ws = tables.load_workspace(x.spark, x.sf_dir, ["customer"])
    return ws["customer"].agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("nations"))


_STATS = "count(*) AS row_count, min(date) AS earliest_date, max(date) AS latest_date, " + r("sum(revenue_usd)", 2) + " AS total_amount"


@query(sql(f"SELECT {_STATS}, 'source' AS side FROM clean UNION ALL SELECT {_STATS}, 'copy' AS side FROM clean", "clean"))
def table_copy_with_validation(x):
    return tables.copy_table(x.clean, scratch(x.spark, "copy"), "date", "revenue_usd")


_MART = 16


@query(sql("SELECT brand, year, count(*) AS rows, " + r("sum(revenue_usd)", 2) + " AS revenue FROM clean JOIN product USING (productkey) WHERE geokey < 5 GROUP BY ALL", "clean", "product"))
def bucketed_mart(x):
    """Fact and products dealt alike: the join needs no shuffle; the fact lies in Z-order of country and date, so the filter skips row groups."""
    name = lambda n: f"mart_{n}_{uuid.uuid4().hex}"
    near = ["geokey", F.datediff("date", F.lit("1990-01-01"))]
    fact = tables.save_mart(x.clean.select("productkey", "geokey", "date", "year", "revenue_usd"), name("fact"), ["productkey"], _MART, scratch(x.spark, "mart"), near)
    product = tables.save_mart(x.product.select("productkey", "brand"), name("product"), ["productkey"], _MART, scratch(x.spark, "mart"))
    return fact.where("geokey < 5").join(product, "productkey").groupBy("brand", "year").agg(F.count(F.lit(1)).alias("rows"), fx.exact_round(F.sum("revenue_usd"), 2).alias("revenue"))


@query(sql("SELECT CAST(load_date AS DATE) AS load_date, count(*) AS n FROM fact, (VALUES ('2024-01-01'), ('2024-01-02')) t(load_date) GROUP BY ALL", "fact"))
def bronze_append_by_load_date(x):
    path = scratch(x.spark, "bronze")
    for day in ("2024-01-01", "2024-01-02"):
        tables.write_bronze(x.fact, path, day, ["date"])
    return x.spark.read.parquet(path).groupBy("load_date").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT count(*) AS n FROM route WHERE hora_entrega IS NULL AND ejecucion_entrega IS DISTINCT FROM 'CANCELLED'", "route"))
def csv_sink_of_anomalies(x):
    path = scratch(x.spark, "anomalies")
    tables.write_csv(q.isolate(x.route, "hora_entrega", "ejecucion_entrega", "CANCELLED"), path)
    return tables.load_table(x.spark, path + "/*.csv", schema=x.route.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
                             ).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT country, countrycode, region FROM geography WHERE region = 'ASIA'", "geography"))
def view_over_a_frame(x):
    tables.create_view(x.geography, "plumbline_geography")
    return x.spark.sql("SELECT country, countrycode, region FROM plumbline_geography WHERE region = 'ASIA'")


@query(sql("SELECT transactionid, CAST(revenue_usd AS DOUBLE) AS revenue_usd, brand, country FROM enriched ORDER BY revenue_usd DESC, transactionid LIMIT 10", "enriched"))
def enriched_preview(x):
    top = w.preview(x.enriched, [F.desc("revenue_usd"), "transactionid"], 10)
    return top.select("transactionid", F.col("revenue_usd").cast("double").alias("revenue_usd"), "brand", "country")


# --- audit ---------------------------------------------------------------------------------
@query(sql(_counts(_TABLES), *_TABLES))
def table_row_counts(x):
    return q.row_counts({n: getattr(x, n) for n in _TABLES})


@query(sql("SELECT t.*, e.expected, CASE WHEN e.expected IS NULL THEN 'UNCHECKED' WHEN e.expected = row_count THEN 'PASS' ELSE 'FAIL' END AS status "
           f"FROM ({_counts(_TABLES)}) t LEFT JOIN (VALUES ('geography', CAST(25 AS BIGINT)), ('channel', 5), ('segment', 4)) e(table_name, expected) "
           "USING (table_name)", *_TABLES))
def expected_row_counts(x):
    return q.expected_counts(table_row_counts(x), {"geography": 25, "channel": 5, "segment": 4})


@query(sql("SELECT transactionid, count(*) AS occurrences FROM fact GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20", "fact"))
def duplicate_transactions_top(x):
    return w.top_n(q.duplicate_keys(x.fact, ["transactionid"]), [F.desc("occurrences"), "transactionid"], 20)


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_order_lines(x):
    return q.duplicate_keys(x.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(sql(" UNION ALL ".join(f"SELECT '{n} {k}' AS check_name, count(*) - count(DISTINCT {k}) AS duplicates FROM {n}" for n, k in
       (("product", "productkey"), ("product", "subcategory"), ("geography", "geokey"), ("channel", "channelkey"), ("dates", "date"))),
       "product", "geography", "channel", "dates"))
def duplicate_excess_of_dimensions(x):
    return q.stack_checks([q.duplicate_excess(getattr(x, n), k, f"{n} {k}") for n, k in (
        ("product", "productkey"), ("product", "subcategory"), ("geography", "geokey"), ("channel", "channelkey"), ("dates", "date"))])


@query("SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows FROM (SELECT *, "
       "count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 100 = 0) GROUP BY ALL HAVING count(*) > 1)")
def exact_duplicate_rows(x):
    """All columns count. Some rows are put in twice on purpose, else there would be nothing to find."""
    lines = x.table("lineitem")
    return q.exact_duplicates(lines.unionAll(lines.filter("l_orderkey % 100 = 0")))


@query("SELECT doc_id, lower(trim(source)) AS entity, n AS times_seen FROM documents d JOIN (SELECT lower(trim(source)) AS e, count(*) AS n "
       "FROM documents GROUP BY 1 HAVING count(*) > 1) g ON lower(trim(d.source)) = g.e WHERE trim(source) <> ''")
def repeated_entities(x):
    return q.repeated_entities(x.table("documents").select("doc_id", "source"), "source").select("doc_id", "entity", "times_seen")


@query(sql("SELECT column_name, nulls FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in (
    "productkey", "product_name", "brand", "division", "category", "subcategory", "type")) + " FROM product) UNPIVOT (nulls FOR column_name IN "
    "(productkey, product_name, brand, division, category, subcategory, type))", "product"))
def null_counts_of_product(x):
    return q.null_counts(x.product)


@query(sql("SELECT column_name, nulls FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in (
    "spend", "impressions", "clicks", "engagements", "video_views")) + " FROM media_raw) UNPIVOT (nulls FOR column_name IN "
    "(spend, impressions, clicks, engagements, video_views)) WHERE nulls > 0", "media_raw"))
def null_counts_of_media(x):
    return q.null_counts(x.media_raw, ["spend", "impressions", "clicks", "engagements", "video_views"], only_positive=True)


_RANGES = {
    "negative_revenue": "revenue_usd < 0", "zero_or_neg_quantity": "quantity <= 0", "low_margin": "margin_pct < 30",
    "margin_over_100pct": "margin_pct > 100", "negative_discount": "discount_pct < 0", "big_discount": "discount_pct > 5",
    "negative_cogs": "cogs_usd < 0", "zero_or_neg_price": "unitprice_usd <= 0",
}


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM fact" for n, c in _RANGES.items()), "fact"))
def range_rules_of_fact(x):
    return q.range_checks(x.fact, {n: F.expr(c) for n, c in _RANGES.items()})


_ORPHAN = [("l_partkey", "part", "p_partkey", "p_partkey % 10 <> 0"), ("l_suppkey", "supplier", "s_suppkey", "s_suppkey % 7 <> 0"),
           ("l_orderkey", "orders", "o_orderkey", "o_custkey % 50 <> 0")]


@query(" UNION ALL ".join(f"SELECT 'orphan {k}' AS issue, count(*) AS orphan_rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {dk} = {k} AND {c})"
                          for k, t, dk, c in _ORPHAN))
def orphans_of_lineitem(x):
    return q.orphans(x.table("lineitem"), [(k, x.table(t).filter(c), dk) for k, t, dk, c in _ORPHAN])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orders_without_parent(x):
    c = x.table("customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return q.missing_parent(x.table("orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query("SELECT exists, count(*) AS n FROM (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS exists FROM orders) GROUP BY 1")
def existence_split(x):
    c = x.table("customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return q.split_by_existence(x.table("orders"), c, ["o_custkey"]).groupBy("exists").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT min(date) AS earliest_date, max(date) AS latest_date, count(DISTINCT date) AS distinct_dates, count(DISTINCT year) AS distinct_years FROM fact", "fact"))
def date_range_of_fact(x):
    return q.date_range(x.fact, "date")


@query(sql("SELECT countrycode, country, count(*) AS transactions, " + r("sum(revenue_usd)", 2) + " AS total_revenue, "
           + r("CAST(sum(revenue_usd) AS DOUBLE) / CAST(sum(sum(revenue_usd)) OVER () AS DOUBLE) * 100", 1)
           + " AS revenue_share_pct FROM fact JOIN geography USING (geokey) GROUP BY 1, 2", "fact", "geography"))
def revenue_share_by_country(x):
    return kpi.share_by(x.fact.join(x.geography, "geokey"), ["countrycode", "country"])


_PCT = {"p1": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}


@query(sql("SELECT " + r("avg(CAST(revenue_usd AS DOUBLE))", 2) + " AS mean, " + r("stddev_samp(CAST(revenue_usd AS DOUBLE))", 2) + " AS stddev, "
           + ", ".join(f"CAST(quantile_disc(revenue_usd, {p}) AS DOUBLE) AS {n}" for n, p in _PCT.items())
           + ", CAST(max(revenue_usd) AS DOUBLE) AS max FROM fact", "fact"))
def revenue_stats(x):
    return q.value_stats(x.fact, "revenue_usd")


@query()
def revenue_stats_sketch(x):
    return q.value_stats(x.fact, "revenue_usd", exact=False)


@query(sql("SELECT countrycode, currency, row_count, currencies, currencies = 1 AS consistent FROM (SELECT countrycode, f.currency, count(*) AS row_count, "
           "count(*) OVER (PARTITION BY countrycode) AS currencies FROM fact f JOIN geography USING (geokey) GROUP BY 1, 2)", "fact", "geography"))
def currency_per_country(x):
    return q.currency_consistency(x.fact, x.geography, "geokey")


_DENSITY = "year(date)::INT AS sale_year, month(date)::INT AS sale_month, count(*) AS transactions, " + r("sum(revenue_usd)", 0) + " AS total"


@query(sql(f"SELECT {_DENSITY} FROM fact GROUP BY 1, 2", "fact"))
def month_density(x):
    return q.month_density(x.fact, "date", "revenue_usd")


@query(sql("SELECT year(m)::INT AS sale_year, month(m)::INT AS sale_month, coalesce(n, 0) AS transactions, coalesce(t, 0) AS total FROM "
           "(SELECT CAST(unnest(generate_series(CAST(min(date_trunc('month', date)) AS TIMESTAMP), CAST(max(date_trunc('month', date)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m "
           "FROM fact WHERE month <> 3) LEFT JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS n, " + r("sum(revenue_usd)", 0)
           + " AS t FROM fact WHERE month <> 3 GROUP BY 1) USING (m)", "fact"))
def month_density_with_gaps(x):
    return q.month_density(x.fact.filter("month <> 3"), "date", "revenue_usd", fill_gaps=True)


@query(sql("SELECT brand, division, count(*) AS product_count FROM product GROUP BY 1, 2", "product"))
def brand_division_counts(x):
    return q.attribute_counts(x.product, ["brand", "division"])


@query(sql("SELECT category, subcategory, count(*) AS product_count FROM product GROUP BY 1, 2", "product"))
def category_counts(x):
    return q.attribute_counts(x.product, ["category", "subcategory"])


@query(sql("SELECT DISTINCT brand, division FROM product WHERE brand IS NOT NULL", "product"))
def distinct_brands(x):
    return q.distinct_attrs(x.product.filter("brand IS NOT NULL"), ["brand", "division"])


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def nations_of_either_side(x):
    return q.union_distinct(x.table("customer").select(F.col("c_nationkey").alias("nationkey")),
                            x.table("supplier").select(F.col("s_nationkey").alias("nationkey")))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def nations_of_both_sides(x):
    return q.common_keys(x.table("customer").select(F.col("c_nationkey").alias("nationkey")),
                         x.table("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")), ["nationkey"])


_STAR = {"product": ("productkey", "productkey % 10 <> 0"), "geography": ("geokey", "geokey <> 3"), "channel": ("channelkey", "channelkey <> 4"),
         "segment": ("segmentkey", "segmentkey <> ascii('B')"), "dates": ("date", "day(date) <> 13")}
_FACT_COLS = ("transactionid", "date", "productkey", "geokey", "channelkey", "segmentkey", "quantity", "revenue_usd", "cogs_usd", "discount_pct", "unitprice_usd",
              "currency", "suppkey", "shipdate", "margin_usd", "margin_pct", "year", "month", "quarter")


_MEMBERS = {n: (k, "productkey % 10 <> 0" if n == "product" else "TRUE") for n, (k, _) in _STAR.items()}


def _audit_sql(members) -> str:
    return sql("SELECT *, CASE WHEN \"check\" = 'row_count' THEN 'INFO' WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
               + " UNION ALL ".join(
                   ["SELECT 'row_count' AS \"check\", 'fact' AS scope, count(*) AS value FROM fact", "SELECT 'duplicate', 'fact', count(*) - count(DISTINCT transactionid) FROM fact"]
                   + [f"SELECT 'row_count', '{n}', count(*) FROM {n} WHERE {c}" for n, (_, c) in members.items()]
                   + [f"SELECT 'duplicate', '{n}', count(*) - count(DISTINCT {k}) FROM {n} WHERE {c}" for n, (k, c) in members.items()]
                   + [f"SELECT 'nulls', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM fact" for c in _FACT_COLS]
                   + [f"SELECT 'orphan', 'orphan {k}', count(*) FROM fact LEFT JOIN (SELECT DISTINCT {k}, true AS known FROM {n} WHERE {c}) d USING ({k}) WHERE known IS NULL" for n, (k, c) in members.items()]
                   + [f"SELECT 'range', '{n}', count(*) FILTER (WHERE {c}) FROM fact" for n, c in _RANGES.items()])
               + ")", "fact", *members)


def _audited(x, members):
    dims = {n: (getattr(x, n).filter(c), k, k) for n, (k, c) in members.items()}
    return q.audit(write_once(x.fact, "audited"), "transactionid", dims, {n: F.expr(c) for n, c in _RANGES.items()})


@query(_audit_sql(_MEMBERS))
def audit_report(x):
    """Every column of the fact, all dimensions and rules; some products are left out on purpose."""
    return _audited(x, _MEMBERS)


@query(_audit_sql(_STAR))
def audit_of_the_whole_star(x):
    """The same with members left out of every dimension, else there would be few orphans. The fact is read by several checks, so it is written once."""
    return _audited(x, _STAR)


# --- cleaning ---------------------------------------------------------------------------------
_CLEAN = "transactionid, date, productkey, CAST(revenue_usd AS DOUBLE) AS revenue_usd, margin_pct, margin_tier, revenue_bucket"


@query(sql(f"SELECT {_CLEAN} FROM clean", "clean"))
def deduplicated_fact_with_bands(x):
    return x.clean.selectExpr(*[c.strip() for c in _CLEAN.split(", ")])


@query(sql("SELECT (SELECT count(*) FROM fact) AS original_rows, (SELECT count(*) FROM clean) AS clean_rows, "
           "(SELECT count(*) FROM fact) - (SELECT count(*) FROM clean) AS duplicates_removed", "clean"))
def dedup_report(x):
    return q.dedup_report(x.fact, x.clean)


@query("SELECT upper(trim(n_name)) AS country_upper, lower(trim(n_name)) AS country_lower, "
       "array_to_string(list_transform(regexp_extract_all(lower(r_name), '[^ -]*[ -]?'), lambda p: upper(p[1]) || p[2:]), '') AS region_first FROM nation JOIN region ON n_regionkey = r_regionkey")
def standardized_geography(x):
    g = x.geography.select(F.col("country").alias("country_upper"), F.col("country").alias("country_lower"),
                                                           F.col("region").alias("region_first"))
    return fx.standardize_text(g, {"country_upper": "upper", "country_lower": "lower", "region_first": "title"})


@query("SELECT DISTINCT o_orderpriority, array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '[^ -]*[ -]?'), "
       "lambda p: upper(p[1]) || p[2:]), '') AS title FROM orders")
def title_case_with_delimiters(x):
    return x.table("orders").select("o_orderpriority", fx.title_case("o_orderpriority").alias("title")).distinct()


@query(sql("SELECT channelkey, channel, channeltype, is_digital FROM channel", "channel"))
def digital_channels(x):
    from ..functions import fixed
    return x.channel.select("channelkey", "channel", "channeltype", fx.flag_in("channel", fixed.DIGITAL_CHANNELS).alias("is_digital"))


@query(sql("SELECT margin_tier, count(*) AS transactions, " + r("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100", 1)
           + " AS pct_of_total FROM clean GROUP BY 1", "clean"))
def margin_tier_distribution(x):
    return kpi.count_share(x.clean, ["margin_tier"])


@query(sql("SELECT is_digital, channeltype, count(*) AS transactions, " + r("sum(revenue_usd)", 2) + " AS total_revenue FROM clean JOIN channel USING (channelkey) GROUP BY 1, 2",
           "clean", "channel"))
def digital_split(x):
    return kpi.rollup_by(x.clean.join(x.channel, "channelkey"), ["is_digital", "channeltype"])


@query(sql("SELECT countrycode, division, count(*) AS transactions, " + r("sum(revenue_usd)", 2) + " AS total_revenue, "
           + r("avg(CAST(margin_pct AS DECIMAL(18,6)))", 2) + " AS avg_margin_pct FROM enriched GROUP BY 1, 2", "enriched"))
def revenue_by_country_and_division(x):
    return kpi.rollup_by(x.enriched, ["countrycode", "division"], margin="margin_pct")


@query(sql("SELECT transactionid, quarter_year, weekday_name, month_name, is_weekend, is_holiday_season, brand, category, country, region, channel, "
           "is_digital, segment FROM enriched", "enriched"))
def enriched_view(x):
    return x.enriched.select("transactionid", "quarter_year", "weekday_name", "month_name", "is_weekend", "is_holiday_season", "brand",
                             "category", "country", "region", "channel", "is_digital", "segment")


# --- snowflake -----------------------------------------------------------------------------------
@query(sql("SELECT * FROM brands", "brands"))
def brand_dimension(x):
    return x.brands


@query(sql("SELECT * FROM categories", "categories"))
def category_dimension(x):
    return x.categories


@query(sql("SELECT * FROM slim", "slim"))
def slim_product(x):
    return x.slim


@query(sql("SELECT p.productkey, p.product_name, b.brand_id, c.category_id, p.brand AS brand_name_ref, p.category AS category_name_ref FROM "
           "(SELECT * REPLACE (CASE WHEN productkey % 2 = 0 THEN ' ' || lower(brand) ELSE brand END AS brand) FROM product) p "
           "LEFT JOIN brands b ON upper(trim(p.brand)) = upper(trim(b.brand_name)) LEFT JOIN categories c ON upper(trim(p.category)) = upper(trim(c.category_name)) "
           "AND upper(trim(coalesce(p.subcategory, p.category))) = upper(trim(c.subcategory_name))", "product", "brands", "categories"))
def slim_product_folded(x):
    messy = x.product.withColumn("brand", F.when(F.col("productkey") % 2 == 0, F.concat(F.lit(" "), F.lower("brand"))).otherwise(F.col("brand")))
    return model.build_slim(messy, x.brands, x.categories, fold=True)


@query(sql("SELECT count(*) FILTER (WHERE brand_id IS NULL) AS no_brand, count(*) AS unmatched FROM slim2 WHERE brand_id IS NULL OR category_id IS NULL",
           "product", "brands", "categories").replace("\nSELECT count", ", slim2 AS (SELECT p.productkey, b.brand_id, c.category_id FROM product p LEFT JOIN "
           "(SELECT * FROM brands WHERE brand_name <> 'Brand#7') b ON p.brand = b.brand_name LEFT JOIN (SELECT * FROM categories WHERE category_name <> 'Makeup') c "
           "ON p.category = c.category_name AND coalesce(p.subcategory, p.category) = c.subcategory_name)\nSELECT count", 1))
def products_without_lookup(x):
    slim = model.build_slim(x.product, x.brands.filter("brand_name <> 'Brand#7'"), x.categories.filter("category_name <> 'Makeup'"))
    return q.unmatched(slim, ["brand_id", "category_id"]).agg(
        F.count_if(F.col("brand_id").isNull()).alias("no_brand"), F.count(F.lit(1)).alias("unmatched"))


_FAN = ", fan AS (SELECT p.productkey FROM product p LEFT JOIN (SELECT DISTINCT brand, type FROM product) b USING (brand))\n"


@query(sql("SELECT (SELECT count(*) FROM product) AS source_rows, (SELECT count(*) FROM fan) AS derived_rows, (SELECT count(*) FROM product) - "
           "(SELECT count(*) FROM fan) AS lost_rows, CASE WHEN (SELECT count(*) FROM product) = (SELECT count(*) FROM fan) THEN 'PASS' ELSE 'FAIL' END AS status",
           "product").replace("\nSELECT (", _FAN + "SELECT (", 1))
def fan_out_is_detected(x):
    by_type = x.product.select("productkey", "product_name", "brand", F.col("type").alias("division"), "category", "subcategory")
    return q.preserves_rows(x.product, model.build_slim(by_type, model.brand_dim(by_type), x.categories))


_SNOW = "FROM clean JOIN slim USING (productkey) JOIN brands USING (brand_id) JOIN categories USING (category_id)"


@query(sql(f"SELECT transactionid, brand_name, division, is_luxury, category_name, subcategory_name, CAST(revenue_usd AS DOUBLE) AS revenue_usd, quantity {_SNOW} "
           "ORDER BY revenue_usd DESC, transactionid LIMIT 20", "clean", "slim"))
def snowflake_top_sales(x):
    joined = model.snowflake_join(x.clean, x.slim, x.brands, x.categories)
    return w.top_n(joined, [F.desc("revenue_usd"), "transactionid"], 20).select(
        "transactionid", "brand_name", "division", "is_luxury", "category_name", "subcategory_name",
        F.col("revenue_usd").cast("double").alias("revenue_usd"), "quantity")


def _differences(star: str) -> str:
    """Totals of one path that the other one has not, counted both ways."""
    return ("SELECT brand_name, division, CAST(total AS DOUBLE) AS total, CAST(sum(w) AS BIGINT) AS balance, CASE WHEN sum(w) > 0 THEN 'first' ELSE 'second' END AS only_in FROM ("
            f"SELECT brand_name, division, sum(revenue_usd) AS total, 1 AS w {_SNOW} GROUP BY ALL UNION ALL "
            f"SELECT brand AS brand_name, division, sum(revenue_usd), -1 FROM clean JOIN product USING (productkey) WHERE {star} GROUP BY ALL) GROUP BY brand_name, division, total HAVING sum(w) <> 0")


def _both_paths(x, star: str):
    snow = model.snowflake_join(x.clean, x.slim, x.brands, x.categories).groupBy("brand_name", "division").agg(F.sum("revenue_usd").alias("total"))
    flat = x.clean.join(x.product, "productkey").where(star).groupBy(F.col("brand").alias("brand_name"), "division").agg(F.sum("revenue_usd").alias("total"))
    return q.same_totals(snow, flat).withColumn("total", F.col("total").cast("double"))


@query(sql(_differences("TRUE"), "clean", "slim"))
def star_equals_snowflake(x):
    """Empty when both paths to the brand give the same revenue."""
    return _both_paths(x, "TRUE")


@query(sql(_differences("productkey % 97 <> 0"), "clean", "slim"))
def star_without_some_products(x):
    """The same where one path loses products: their brands stand on both sides, with either total."""
    return _both_paths(x, "productkey % 97 <> 0")


@query(sql("SELECT brand_tier, division, count(DISTINCT brand_id) AS brand_count, " + r("sum(revenue_usd)", 2) + " AS total_revenue, "
           + r("CAST(sum(sustainability_score) AS DOUBLE) / count(*)", 1) + f" AS avg_sustainability_score {_SNOW} GROUP BY 1, 2", "clean", "slim"))
def revenue_by_brand_tier(x):
    joined = model.snowflake_join(x.clean, x.slim, x.brands, x.categories)
    return model.revenue_by(joined, ["brand_tier", "division"], "brand_id", "brand_count", "sustainability_score")


@query(sql("SELECT growth_priority, margin_profile, count(DISTINCT category_id) AS category_count, " + r("sum(revenue_usd)", 2)
           + f" AS total_revenue {_SNOW} GROUP BY 1, 2", "clean", "slim"))
def revenue_by_growth_priority(x):
    joined = model.snowflake_join(x.clean, x.slim, x.brands, x.categories)
    return model.revenue_by(joined, ["growth_priority", "margin_profile"], "category_id", "category_count")


_RLS = ("SELECT countrycode, count(*) AS n FROM fact JOIN geography USING (geokey) WHERE EXISTS (SELECT 1 FROM security s WHERE useremail = '{u}' "
        "AND (s.countrycode = geography.countrycode OR s.countrycode = 'ALL')) GROUP BY 1")


@query(sql(_RLS.format(u="user3@corp.com"), "fact", "geography", "security"))
def row_level_security_one_country(x):
    rows = model.apply_rls(x.fact.join(x.geography.select("geokey", "countrycode"), "geokey"), x.security, " User3@corp.com")
    return rows.groupBy("countrycode").agg(F.count(F.lit(1)).alias("n"))


@query(sql(_RLS.format(u="user0@corp.com"), "fact", "geography", "security"))
def row_level_security_all(x):
    rows = model.apply_rls(x.fact.join(x.geography.select("geokey", "countrycode"), "geokey"), x.security, "user0@corp.com")
    return rows.groupBy("countrycode").agg(F.count(F.lit(1)).alias("n"))


# --- commercial measures ---------------------------------------------------------------------------
@query(sql("SELECT country, CAST(sum(revenue_usd) AS DOUBLE) AS total FROM fact JOIN geography USING (geokey) GROUP BY 1 HAVING sum(revenue_usd) >= 60000000",
           "fact", "geography"))
def countries_above_a_total(x):
    out = kpi.having(x.fact.join(x.geography, "geokey"), ["country"], "revenue_usd", 60_000_000)
    return out.withColumn("total", F.col("total").cast("double"))


@query("SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total_sales FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON "
       "c_nationkey = n_nationkey WHERE year(o_orderdate) = 1997 GROUP BY 1 HAVING sum(CAST(o_totalprice AS DECIMAL(14,2))) > 20000000")
def sales_by_country_and_year(x):
    o = x.table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.col("o_totalprice").cast("decimal(14,2)").alias("amount"))
    c = x.table("customer").join(x.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = kpi.sales_by_country(o, c, "c_custkey", "n_name", "amount", "o_orderdate", 1997, 20_000_000)
    return out.withColumn("total_sales", F.col("total_sales").cast("double"))


_YOY = "SELECT region, year, sum(revenue_usd) AS v, sum(quantity) AS q FROM fact JOIN geography USING (geokey) GROUP BY 1, 2"


@query(sql("SELECT region, year, CAST(v AS DOUBLE) AS revenue_usd, CAST(q AS BIGINT) AS quantity, " + r("CAST(v - lag(v) OVER w AS DOUBLE) / CAST(lag(v) OVER w AS DOUBLE) * 100", 4)
           + " AS revenue_change_pct, " + r("CAST(q - lag(q) OVER w AS DOUBLE) / CAST(lag(q) OVER w AS DOUBLE) * 100", 4)
           + f" AS quantity_change_pct FROM ({_YOY}) WINDOW w AS (PARTITION BY region ORDER BY year)", "fact", "geography"))
def year_over_year(x):
    out = w.yoy(x.fact.join(x.geography, "geokey"), ["region"], "year", ["revenue_usd", "quantity"])
    return out.select("region", "year", F.col("revenue_usd").cast("double").alias("revenue_usd"), "quantity",
                      fx.exact_round("revenue_usd_change_pct", 4).alias("revenue_change_pct"),
                      fx.exact_round("quantity_change_pct", 4).alias("quantity_change_pct"))


@query(sql("SELECT country, region, CAST(v AS DOUBLE) AS revenue, " + r("round_even(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY region) AS DOUBLE) * 100, 4)", 3)
           + " AS share FROM (SELECT country, region, sum(revenue_usd) AS v FROM fact JOIN geography USING (geokey) GROUP BY 1, 2)", "fact", "geography"))
def share_within_region(x):
    sums = x.fact.join(x.geography, "geokey").groupBy("country", "region").agg(F.sum("revenue_usd").alias("v"))
    return w.add_share(sums, "v", "region", "share").select(
        "country", "region", F.col("v").cast("double").alias("revenue"), fx.exact_round("share", 3).alias("share"))


@query(sql("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS customer_id FROM customer"))
def surrogate_keys_at_scale(x):
    return w.surrogate_key(x.table("customer").select("c_acctbal", "c_custkey"), [F.desc("c_acctbal"), "c_custkey"], "customer_id").drop("c_acctbal")


@query("SELECT o_orderkey, o_custkey, o_orderdate, (SELECT count(*) FROM orders) AS total, TRUE AS has_more, CAST(60 AS INT) AS next_offset FROM orders "
       "ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def paged_orders(x):
    return w.page(x.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 20, 40)


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def most_common_priorities(x):
    return q.value_counts(x.table("orders"), "o_orderpriority", 3)


_NUM = ("quantity", "revenue_usd", "discount_pct", "margin_pct")
_CAT = ("currency", "quarter", "transactionid")


def _describe_sql():
    num = [f"SELECT '{c}' AS column_name, 'numeric' AS type, {r(f'min({c})', 3)} AS min, {r(f'max({c})', 3)} AS max, "
           f"{r(f'avg(CAST({c} AS DOUBLE))', 3)} AS mean, {r(f'stddev_samp(CAST({c} AS DOUBLE))', 3)} AS std, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
           "CAST(NULL AS BIGINT) AS distinct_values, CAST(NULL AS VARCHAR) AS top FROM fact" for c in _NUM]
    cat = [f"SELECT '{c}', 'categorical', NULL, NULL, NULL, NULL, (SELECT count(*) FROM fact WHERE {c} IS NULL), (SELECT count(DISTINCT {c}) FROM fact), "
           f"(SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8))" for c in _CAT]
    return sql(" UNION ALL ".join(num + cat), "fact")


@query(_describe_sql())
def table_description(x):
    return profile.describe_table(x.fact.select(*_NUM, *_CAT))
