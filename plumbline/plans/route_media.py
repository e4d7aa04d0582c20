"""Queries over route, media and staffing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import kpi, quality as q, windows as w
from .oracle import r, sql
from .registry import query

_CVR = "hora_compra, CAST(sum(total_envios) AS BIGINT) AS envios_totales, CAST(sum(visitas) AS BIGINT) AS visitas_totales, " + r(
    "CAST(sum(total_envios) AS DOUBLE) / nullif(sum(visitas), 0)", 6) + " AS cvr"


@query(sql(f"SELECT {_CVR} FROM route_raw GROUP BY 1", "route_raw"))
def conversion_by_hour(x):
    return kpi.cvr_by_hour(x.route_raw)


@query(sql("SELECT mes, CAST(sum(entrega_a_tiempo) AS BIGINT) AS total_on_time, CAST(sum(total_envios) AS BIGINT) AS envios_totales, "
           + r("CAST(sum(entrega_a_tiempo) AS DOUBLE) / nullif(sum(total_envios), 0) * 100", 4) + " AS porcentaje_on_time FROM route GROUP BY 1", "route"))
def on_time_by_month(x):
    return kpi.on_time_by_month(x.route)


@query(sql(f"SELECT {_CVR} FROM route WHERE entrega_demorada = 0 GROUP BY 1 ORDER BY cvr DESC NULLS LAST, 1 LIMIT 3", "route"))
def golden_hours(x):
    return kpi.golden_hour(x.route, 3)


@query(sql("SELECT event_id, origen, destino, hora_compra FROM route", "route"))
def route_rows(x):
    return x.route.select("event_id", "origen", "destino", "hora_compra")


@query(sql("SELECT event_id, mes, hora_compra, ejecucion_entrega FROM route_raw WHERE hora_entrega IS NULL AND (ejecucion_entrega <> 'CANCELLED' OR ejecucion_entrega IS NULL)", "route_raw"))
def undelivered_but_not_cancelled(x):
    return q.isolate(x.route_raw, "hora_entrega", "ejecucion_entrega", "CANCELLED").select("event_id", "mes", "hora_compra", "ejecucion_entrega")


@query(sql("SELECT ejecucion_entrega AS value, count(*) AS n FROM route WHERE hora_entrega IS NULL GROUP BY 1", "route"))
def status_of_missing_delivery_hour(x):
    return q.value_counts(x.route.filter("hora_entrega IS NULL"), "ejecucion_entrega")


@query(sql("SELECT event_id, date, strftime(date, '%Y-%m') AS month, campaign, channel, CAST(coalesce(spend, 0) AS DOUBLE) AS spend, impressions, "
           "coalesce(clicks, 0) AS clicks, coalesce(engagements, 0) AS engagements, link_clicks, coalesce(video_views, 0) AS video_views, "
           + r("coalesce(clicks, 0) * 1.0 + coalesce(video_views, 0) * 0.1 + coalesce(engagements, 0) * 0.5", 4) + " AS weighted_score, "
           + r("CAST(coalesce(spend, 0) AS DOUBLE) / nullif(impressions, 0) * 1000", 6) + " AS cpm FROM media_raw", "media_raw"))
def curated_media(x):
    extra = kpi.media_view(x.media_raw.withColumn("campaign", F.concat_ws("#", "campaign", "event_id")))
    parts = F.split("campaign", "#")
    return extra.select(parts[1].cast("long").alias("event_id"), "date", "month", parts[0].alias("campaign"), "channel",
                        F.col("spend").cast("double").alias("spend"), "impressions", "clicks", "engagements", "link_clicks", "video_views",
                        fx.exact_round("weighted_score", 4).alias("weighted_score"), fx.exact_round("cpm", 6).alias("cpm"))


_KPI = (r("sum(spend)", 2) + " AS total_spend, " + r("sum(CAST(weighted_score AS DECIMAL(18,4)))", 2) + " AS score, "
        + r("CAST(sum(CAST(weighted_score AS DECIMAL(18,4))) AS DOUBLE) / CAST(nullif(sum(spend), 0) AS DOUBLE)", 4) + " AS efficiency_index, "
        + r("CAST(sum(spend) AS DOUBLE) / nullif(sum(impressions), 0) * 1000", 4) + " AS avg_cpm")


@query(sql(f"SELECT {_KPI} FROM media WHERE year(date) = 2024", "media"))
def media_header(x):
    return kpi.media_kpis(kpi.media_view(x.media_raw), 2024)


@query(sql(f"SELECT campaign, month, {_KPI} FROM media GROUP BY 1, 2", "media"))
def media_by_campaign_and_month(x):
    return kpi.media_kpis(kpi.media_view(x.media_raw), by=["campaign", "month"])


@query(sql("SELECT channel, total_spend, " + r("total_spend / sum(total_spend) OVER () * 100", 2) + f" AS spend_share_pct, efficiency_index, avg_cpm FROM (SELECT channel, {_KPI} FROM media GROUP BY 1)", "media"))
def channel_efficiency(x):
    return kpi.channel_efficiency(kpi.media_view(x.media_raw))


@query(sql("SELECT * FROM headcount", "headcount"))
def hourly_headcount(x):
    return kpi.hourly_headcount(x.volume, x.split, x.curve)


@query(sql("SELECT day, CAST(max(p) AS BIGINT) AS peak_people, arg_min(hour, (-p, hour)) AS peak_hour FROM (SELECT day, hour, CAST(sum(people) AS BIGINT) AS p FROM headcount GROUP BY 1, 2) GROUP BY 1", "headcount"))
def daily_peak_headcount(x):
    return kpi.daily_peak(kpi.hourly_headcount(x.volume, x.split, x.curve))


@query(sql("SELECT lane, " + r("quantile_cont(CAST(volume AS DOUBLE), 0.6)", 4) + " AS base FROM volume GROUP BY 1", "volume"))
def base_staffing_percentile(x):
    return kpi.base_staffing(x.volume, ["lane"], "volume", 0.6).withColumn("base", fx.exact_round("base", 4))


@query(sql("SELECT day, lane, volume, base, " + r("s", 2) + " AS ser_pct, CASE WHEN s < 90 THEN 'backlog risk' WHEN s < 95 THEN 'below plan' WHEN s <= 105 THEN 'optimal' "
           "WHEN s <= 115 THEN 'above plan' ELSE 'overstaffed' END AS ser_zone FROM (SELECT day, lane, volume, base, CAST(volume AS DOUBLE) / base * 100 AS s FROM volume JOIN "
           "(SELECT lane, " + r("quantile_cont(CAST(volume AS DOUBLE), 0.6)", 4) + " AS base FROM volume GROUP BY 1) USING (lane))", "volume"))
def staffing_efficiency(x):
    base = base_staffing_percentile(x)
    return kpi.ser(x.volume.join(base, "lane"), "volume", "base")


@query(sql("SELECT event_id, " + r("CAST(value AS DOUBLE) / nullif(user_id % 5, 0) * 1000", 4) + " AS ratio, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y%m%d') AS day_key, "
           "CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(ts AS DATE) AS d FROM events"))
def ratios_and_date_labels(x):
    return x.table("events").select(
        "event_id", fx.exact_round(fx.safe_ratio("value", F.col("user_id") % 5, 1000), 4).alias("ratio"), fx.month_label("ts").alias("month"),
        fx.date_key("ts").alias("day_key"), F.year("ts").alias("y"), F.month("ts").alias("m"), F.to_date("ts").alias("d"))
