"""Commercial, route, media and staffing measures. Ratios are always ratios of
sums; money is summed as decimals, so totals do not depend on task order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import exact_round, fixed, month_label, safe_ratio, weighted_score, zero_fill
from .selection import quantiles
from .windows import share_of_all, top_n


def having(df: DataFrame, by: Sequence[str], metric: str, minimum: float, out: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(metric).alias(out)).filter(F.col(out) >= F.lit(minimum))


def sales_by_country(orders: DataFrame, customers: DataFrame, key: str, country: str, amount: str, date: str,
                     year: int, minimum: float) -> DataFrame:
    """Sales of one year per country of the customer, large countries only. The
    orders are summed per customer before the join."""
    per_customer = orders.filter(F.year(date) == year).groupBy(key).agg(F.sum(amount).alias("_amount"))
    return having(per_customer.join(customers.select(key, country), key), [country], "_amount", minimum, "total_sales")


def rollup_by(df: DataFrame, dims: Sequence[str], revenue: str = "revenue_usd", margin: str | None = None) -> DataFrame:
    """Rows, revenue and mean margin per combination of ``dims``."""
    aggs = [F.count(F.lit(1)).alias("transactions"), exact_round(F.sum(revenue), 2).alias("total_revenue")]
    if margin:
        aggs.append(exact_round(F.avg(F.col(margin).cast("decimal(18,6)")), 2).alias("avg_margin_pct"))
    return df.groupBy(*dims).agg(*aggs)


def share_by(df: DataFrame, dims: Sequence[str], revenue: str = "revenue_usd") -> DataFrame:
    """Revenue per group and its share of the whole."""
    grouped = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("transactions"), F.sum(revenue).alias("_rev"))
    return share_of_all(grouped, "_rev", "share").select(
        *dims, "transactions", exact_round("_rev", 2).alias("total_revenue"),
        exact_round("share", 1).alias("revenue_share_pct"))


def count_share(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows per group and their share of all rows."""
    grouped = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("transactions"))
    return share_of_all(grouped, "transactions", "share").select(
        *dims, "transactions", exact_round("share", 1).alias("pct_of_total"))


# --- route ---------------------------------------------------------------------------
def filter_route(df: DataFrame, year: int, origin: str, destination: str) -> DataFrame:
    return df.filter((F.col("anio") == year) & (F.col("origen") == origin) & (F.col("destino") == destination))


def cvr_by_hour(df: DataFrame) -> DataFrame:
    """Shipments per visit by hour of purchase."""
    return (
        df.groupBy("hora_compra").agg(F.sum("total_envios").alias("envios_totales"),
                                      F.sum("visitas").alias("visitas_totales"))
        .withColumn("cvr", exact_round(safe_ratio("envios_totales", "visitas_totales"), 6))
    )


def on_time_by_month(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("mes").agg(F.sum("entrega_a_tiempo").alias("total_on_time"),
                              F.sum("total_envios").alias("envios_totales"))
        .withColumn("porcentaje_on_time", exact_round(safe_ratio("total_on_time", "envios_totales", 100), 4))
    )


def golden_hour(df: DataFrame, n: int = 3) -> DataFrame:
    """Best hours by conversion among rows with no delayed delivery."""
    ranked = cvr_by_hour(df.filter("entrega_demorada = 0"))
    return top_n(ranked, [F.desc_nulls_last("cvr"), F.col("hora_compra")], n)


# --- media ---------------------------------------------------------------------------
MEDIA_METRICS = ("spend", "impressions", "clicks", "engagements", "link_clicks", "video_views")


def media_view(df: DataFrame) -> DataFrame:
    """Curated media rows: month label, zero for missing metrics, score and CPM."""
    return zero_fill(df, MEDIA_METRICS).select(
        "date", month_label("date").alias("month"), "campaign", "channel", *MEDIA_METRICS,
        weighted_score().alias("weighted_score"), safe_ratio("spend", "impressions", 1000).alias("cpm"))


def media_kpis(df: DataFrame, year: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Total spend, score, efficiency index and weighted CPM over curated rows."""
    rows = df if year is None else df.filter(F.year("date") == year)
    sums = rows.groupBy(*by).agg(F.sum("spend").alias("s"), F.sum("impressions").alias("i"),
                                 F.sum(F.col("weighted_score").cast("decimal(18,4)")).alias("w"))
    return sums.select(
        *by, exact_round("s", 2).alias("total_spend"), exact_round("w", 2).alias("score"),
        exact_round(safe_ratio("w", "s"), 4).alias("efficiency_index"),
        exact_round(safe_ratio("s", "i", 1000), 4).alias("avg_cpm"))


def channel_efficiency(df: DataFrame) -> DataFrame:
    """Share of spend next to score per unit of spend, per channel."""
    return share_of_all(media_kpis(df, by=["channel"]), "total_spend", "share").select(
        "channel", "total_spend", exact_round("share", 2).alias("spend_share_pct"), "efficiency_index", "avg_cpm")


# --- staffing ------------------------------------------------------------------------
def hourly_headcount(volume: DataFrame, split: DataFrame, curve: DataFrame) -> DataFrame:
    """People needed per day, hour and position: volume of the lane x share of
    the position x share of the hour / productivity, rounded up.

    ``volume``: day, lane, volume; ``split``: lane, position, position_share, rate;
    ``curve``: position, hour, hour_share."""
    load = volume.join(split, "lane").join(curve, "position")
    need = F.col("volume") * F.col("position_share") * F.col("hour_share") / F.col("rate")
    # rounded far below one person before ceil, so that 4.0000000001 does not become 5
    return load.select("day", "lane", "hour", "position", F.ceil(F.round(need, 6)).cast("long").alias("people"))


def daily_peak(headcount: DataFrame) -> DataFrame:
    """Peak people per day over the hours, and the first hour it happens."""
    hours = headcount.groupBy("day", "hour").agg(F.sum("people").alias("people"))
    best = F.max(F.struct("people", (-F.col("hour")).alias("h")))
    return hours.groupBy("day").agg(best.alias("b")).select(
        "day", F.col("b.people").alias("peak_people"), (-F.col("b.h")).alias("peak_hour"))


def base_staffing(forecast: DataFrame, by: Sequence[str], col: str, p: float = 0.6) -> DataFrame:
    """Planned base load: the given percentile of the forecast."""
    return quantiles(forecast, by, {"base": (col, p)})


def ser(df: DataFrame, actual: str, plan: str) -> DataFrame:
    """Staffing efficiency ratio in percent, and its zone."""
    low, fair, over, far = fixed.SER_ZONES
    value = safe_ratio(actual, plan, 100)
    zone = (F.when(value.isNull(), "unknown").when(value < low, "backlog risk").when(value < fair, "below plan")
            .when(value <= over, "optimal").when(value <= far, "above plan").otherwise("overstaffed"))
    return df.withColumns({"ser_pct": exact_round(value, 2), "ser_zone": zone})
