"""SQL building blocks of the checks: the same inputs as ``standins``, written
independently as common table expressions."""

from __future__ import annotations

from ..functions import fixed


def r(x: str, n: int) -> str:
    """Half-up rounding on the decimal value."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


EMAIL = r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'"
_DAY = "'%d/%m/%Y %H:%M'"
_COLS = fixed.RAW_COLUMNS
_quoted = lambda c: (f"CASE WHEN regexp_matches(coalesce({c},''), '[,\"]') THEN '\"' || replace({c},'\"','\"\"') || '\"' "  # noqa: E731
                     f"ELSE coalesce({c},'') END")
_blank = lambda c: f"nullif(nullif(trim({c}),''),'-')"
_int = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^[0-9]+$') THEN CAST(trim({c}) AS BIGINT) ELSE 0 END"
_sent = "(TIMESTAMP '2024-01-01 08:00:00' + to_days(CAST(((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) // 3) * 3 AS INT)))"


def _rule(code: str, sev: str, field: str, value: str, cond: str) -> str:
    return (f"SELECT id_ejecucion, file_id, line_no, registro_completo, '{code}' AS codigo_error, '{sev}' AS severidad, "
            f"'{field}' AS campo, left({value}, 500) AS valor_original FROM ranked WHERE {cond}")


_UNREAD = "rn = 1 AND {d} IS NULL AND coalesce({d}_txt,'') NOT IN ('','-')"
_RULES = [
    _rule("V-03", "RECHAZO", "email", "email_original", "NOT email_ok"),
    _rule("V-04", "RECHAZO", "Fecha envio", "fecha_envio_txt", "email_ok AND fecha_envio IS NULL"),
    _rule("V-05", "ADVERTENCIA", "Fecha open", "fecha_open_txt", _UNREAD.format(d="fecha_open")),
    _rule("V-05", "ADVERTENCIA", "Fecha click", "fecha_click_txt", _UNREAD.format(d="fecha_click")),
    _rule("V-06", "ADVERTENCIA", "Opens / Clicks", "registro_completo", "rn = 1 AND NOT numericos_ok"),
    _rule("V-07", "ADVERTENCIA", "email + Fecha envio", "email || ' | ' || coalesce(fecha_envio_txt,'')", "rn > 1"),
    _rule("V-08", "ADVERTENCIA", "Fecha open", "'envio=' || coalesce(fecha_envio_txt,'') || ' open=' || coalesce(fecha_open_txt,'')",
          "rn = 1 AND fecha_open < fecha_envio"),
    _rule("V-10", "ADVERTENCIA", "Opens / Clicks", "'opens=' || opens || ' clicks=' || clicks",
          "rn = 1 AND clicks > 0 AND fecha_open IS NULL"),
]

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fact0": ((), """SELECT l_orderkey || '-' || l_linenumber AS transactionid, CAST(o_orderdate AS DATE) AS date,
        l_partkey AS productkey, c_nationkey AS geokey, CAST(left(o_orderpriority,1) AS INT) AS channelkey,
        ascii(c_mktsegment) AS segmentkey, CAST(l_quantity AS INT) AS quantity,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue_usd,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.30 + (l_partkey % 50) * 0.01 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS cogs_usd,
        CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DOUBLE) AS discount_pct,
        """ + r("CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) / l_quantity", 2) + """ AS unitprice_usd,
        CASE WHEN l_orderkey % 997 = 0 THEN 'USD' ELSE 'CUR' || (c_nationkey % 5) END AS currency,
        l_suppkey AS suppkey, CAST(l_shipdate AS DATE) AS shipdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""),
    "fact": (("fact0",), """SELECT *, CAST(revenue_usd - cogs_usd AS DECIMAL(18,4)) AS margin_usd,
        """ + r("CAST(revenue_usd - cogs_usd AS DOUBLE) / CAST(revenue_usd AS DOUBLE) * 100", 4) + """ AS margin_pct,
        CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, 'Q' || quarter(date) AS quarter FROM fact0"""),
    "clean": (("fact",), """SELECT * EXCLUDE (rn), CASE WHEN margin_pct >= 70 THEN 'Premium (70%+)' WHEN margin_pct >= 55
        THEN 'Healthy (55–70%)' WHEN margin_pct >= 40 THEN 'Standard (40–55%)' ELSE 'Low (<40%)' END AS margin_tier,
        CASE WHEN revenue_usd >= 500 THEN '500+' WHEN revenue_usd >= 200 THEN '200–499' WHEN revenue_usd >= 100
        THEN '100–199' WHEN revenue_usd >= 50 THEN '50–99' ELSE '<50' END AS revenue_bucket
        FROM (SELECT *, row_number() OVER (PARTITION BY transactionid ORDER BY date, productkey, revenue_usd, suppkey,
        shipdate, quantity) AS rn FROM fact) WHERE rn = 1"""),
    "product": ((), """SELECT p_partkey AS productkey, p_name AS product_name, p_brand AS brand,
        CASE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 4 WHEN 0 THEN 'LUXE' WHEN 1 THEN 'CPD' WHEN 2 THEN 'PPD'
        ELSE 'Active Cosmetics' END AS division,
        CASE p_type WHEN 'PROMO' THEN 'Skincare' WHEN 'ECONOMY' THEN 'Makeup' WHEN 'STANDARD' THEN 'Haircare'
        WHEN 'MEDIUM' THEN 'Fragrance' WHEN 'LARGE' THEN 'Digital' ELSE 'Other' END AS category,
        CASE WHEN p_size % 10 <> 0 THEN split_part(p_name, ' ', 2) END AS subcategory, p_type AS type FROM part"""),
    "geography": ((), """SELECT n_nationkey AS geokey, n_name AS country, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS countrycode,
        r_name AS region, 'CUR' || (n_nationkey % 5) AS currency FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "channel": ((), """SELECT k AS channelkey, CASE k WHEN 1 THEN 'E-commerce' WHEN 2 THEN 'D2C' ELSE substr(p, 3) END AS channel,
        CASE WHEN k <= 2 THEN 'Online' ELSE 'Store' END AS channeltype, k <= 2 AS is_digital
        FROM (SELECT DISTINCT o_orderpriority AS p, CAST(left(o_orderpriority,1) AS INT) AS k FROM orders)"""),
    "segment": ((), "SELECT DISTINCT ascii(c_mktsegment) AS segmentkey, c_mktsegment AS segment FROM customer"),
    "dates": ((), """SELECT d AS date, monthname(d) AS month_name, 'Q' || quarter(d) || ' ' || year(d) AS quarter_year,
        dayname(d) AS weekday_name, dayofweek(d) IN (0, 6) AS is_weekend, month(d) IN (11, 12) AS is_holiday_season
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"""),
    "security": ((), """SELECT 'user' || s_suppkey || '@corp.com' AS useremail, CASE WHEN s_suppkey % 10 = 0 THEN 'ALL'
        ELSE 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS countrycode FROM supplier"""),
    "enriched": (("clean", "product", "geography", "channel", "segment", "dates"), """SELECT f.*, p.brand, p.division, p.category,
        p.subcategory, g.country, g.countrycode, g.region, c.channel, c.channeltype, c.is_digital, s.segment, d.month_name,
        d.quarter_year, d.weekday_name, d.is_weekend, d.is_holiday_season
        FROM clean f JOIN product p USING (productkey) JOIN geography g USING (geokey) JOIN channel c USING (channelkey)
        JOIN segment s USING (segmentkey) JOIN dates d ON d.date = f.date"""),
    "brands": (("product",), """SELECT row_number() OVER (ORDER BY brand, division) AS brand_id, brand AS brand_name, division,
        CASE WHEN division = 'LUXE' THEN 'Luxury' WHEN division = 'PPD' THEN 'Premium' ELSE 'Mass' END AS brand_tier,
        division = 'LUXE' AS is_luxury, FALSE AS digital_priority, 6 AS sustainability_score, 2005 AS latam_launch_year
        FROM (SELECT DISTINCT brand, division FROM product WHERE brand IS NOT NULL)"""),
    "categories": (("product",), """SELECT row_number() OVER (ORDER BY category, subcategory NULLS FIRST) AS category_id,
        category AS category_name, coalesce(subcategory, category) AS subcategory_name,
        CASE WHEN category IN ('Skincare','Makeup') THEN 'High' WHEN category IN ('Haircare','Fragrance') THEN 'Medium'
        ELSE 'Low' END AS growth_priority, category = 'Digital' AS is_digital_first, category = 'Skincare' AS sold_online_first,
        CASE WHEN category IN ('Fragrance','Skincare','Makeup') THEN 'High' ELSE 'Medium' END AS margin_profile
        FROM (SELECT DISTINCT category, subcategory FROM product WHERE category IS NOT NULL)"""),
    "slim": (("product", "brands", "categories"), """SELECT p.productkey, p.product_name, b.brand_id, c.category_id,
        p.brand AS brand_name_ref, p.category AS category_name_ref FROM product p LEFT JOIN brands b ON p.brand = b.brand_name
        LEFT JOIN categories c ON p.category = c.category_name AND coalesce(p.subcategory, p.category) = c.subcategory_name"""),
    # --- campaign files ---------------------------------------------------------------
    "raw": ((), f"""SELECT run AS id_ejecucion, run * 10 + event_id % 3 AS file_id, event_id // 3 + 2 AS line_no,
        CASE WHEN event_id % 97 = 0 THEN 'bad@mail' WHEN event_id % 89 = 0 THEN '' WHEN event_id % 11 = 0 THEN upper(adr) ELSE adr END AS email,
        '' AS jyv, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'HARD' ELSE '-' END AS badmail,
        CASE WHEN event_id % 17 = 0 THEN 'SI' ELSE 'NO' END AS baja,
        CASE WHEN event_id % 101 = 0 THEN strftime(sent, '%Y-%m-%d %H:%M') ELSE strftime(sent, {_DAY}) END AS fecha_envio,
        CASE WHEN event_id % 103 = 0 THEN '31/31/2013 10:00'
             WHEN event_type IN ('view','click') AND event_id % 19 = 0 THEN strftime(sent - INTERVAL 90 MINUTE, {_DAY})
             WHEN event_type IN ('view','click') THEN strftime(ts, {_DAY})
             WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN '' ELSE '-' END AS fecha_open,
        CASE WHEN event_id % 107 = 0 THEN 'abc' WHEN event_id % 109 = 0 THEN '-' WHEN event_type = 'view' THEN CAST(1 + event_id % 4 AS VARCHAR)
             WHEN event_type = 'click' THEN CAST(1 + event_id % 2 AS VARCHAR) ELSE '0' END AS opens,
        CAST(event_id * 7 % 3 AS VARCHAR) AS opens_virales,
        CASE WHEN event_id % 113 = 0 THEN 'soon' WHEN event_type IN ('click','purchase') THEN strftime(ts + INTERVAL 5 MINUTE, {_DAY})
             ELSE '-' END AS fecha_click,
        CASE event_type WHEN 'click' THEN CAST(1 + event_id % 2 AS VARCHAR) WHEN 'purchase' THEN '1' ELSE '0' END AS clicks,
        CAST(event_id % 2 AS VARCHAR) AS clicks_virales,
        CASE WHEN event_type IN ('click','purchase') AND event_id % 23 <> 0 THEN CAST(event_id % 50 AS VARCHAR)
             WHEN event_type = 'view' AND event_id % 29 = 0 THEN '7' ELSE '' END AS links,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '-' ELSE '10.0.' || (user_id % 250) || '.1' ||
             CASE WHEN event_id % 4 = 0 THEN ', 10.1.' || (event_id % 250) || '.2' ELSE '' END END AS ips,
        CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' ELSE '-' END AS navegadores,
        CASE event_id % 5 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Android' WHEN 2 THEN 'iOS' WHEN 3 THEN '' ELSE 'Mac' END ||
             CASE WHEN event_id % 127 = 0 THEN chr(13) ELSE '' END AS plataformas
        FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS run, {_sent} AS sent,
                     'user' || user_id || '@mail' || (user_id % 7) || '.com' AS adr FROM events)"""),
    "staged": (("raw",), "SELECT id_ejecucion, file_id, line_no, " + ", ".join(
        f"nullif(trim(rtrim({c}, chr(13))), '') AS {c}" for c in _COLS) + " FROM raw"),
    "work": (("staged",), "SELECT id_ejecucion, file_id, line_no, lower(trim(email)) AS email, trim(email) AS email_original, "
        + ", ".join(f"{_blank(c)} AS {c}" for c in ("jyv", "badmail", "baja", "links", "ips", "navegadores", "plataformas")) + ", "
        + ", ".join(f"trim({c}) AS {c}_txt, try_strptime({_blank(c)}, {_DAY}) AS {c}" for c in ("fecha_envio", "fecha_open", "fecha_click"))
        + ", " + ", ".join(f"{_int(c)} AS {c}" for c in ("opens", "opens_virales", "clicks", "clicks_virales"))
        + ", trim(opens) AS opens_txt, trim(clicks) AS clicks_txt, regexp_matches(trim(opens), '^[0-9]+$') AND regexp_matches(trim(clicks), '^[0-9]+$') AS numericos_ok, "
        + f"coalesce(regexp_matches(trim(email), {EMAIL}), FALSE) AS email_ok, "
        + " || ',' || ".join(f"({_quoted(c)})" for c in _COLS) + " AS registro_completo FROM staged"),
    "ranked": (("work",), """SELECT *, CASE WHEN email_ok AND fecha_envio IS NOT NULL THEN row_number() OVER (
        PARTITION BY id_ejecucion, email, fecha_envio, (email_ok AND fecha_envio IS NOT NULL)
        ORDER BY opens DESC, clicks DESC, line_no DESC, file_id DESC) END AS rn FROM work"""),
    "recinc": (("ranked",), " UNION ALL ".join(_RULES)),
    "fileinc": (("ranked",), "SELECT id_ejecucion, file_id, 'V-09' AS codigo_error, 'ADVERTENCIA' AS severidad, campo FROM ("
        + " UNION ALL ".join(f"SELECT id_ejecucion, file_id, '{c}' AS campo FROM ranked GROUP BY ALL HAVING count({c}) = 0"
                             for c in fixed.EMPTY_CHECKED) + ")"),
    "incidents": (("recinc", "fileinc"), """SELECT * FROM recinc UNION ALL BY NAME SELECT * FROM fileinc"""),
    "loaded": (("ranked",), "SELECT * FROM ranked WHERE id_ejecucion % 11 <> 0"),
    "stats": (("loaded",), """SELECT email, fecha_envio, max(opens) AS opens, max(opens_virales) AS opens_virales, max(clicks) AS clicks,
        max(clicks_virales) AS clicks_virales, """
        + ", ".join(f"last({c} ORDER BY id_ejecucion, file_id, line_no) AS {c}" for c in
                    ("fecha_open", "fecha_click", "links", "ips", "navegadores", "plataformas")) + ", "
        + ", ".join(f"first({c} ORDER BY id_ejecucion, file_id, line_no) AS {c}" for c in ("jyv", "badmail", "baja", "file_id"))
        + " FROM loaded WHERE rn = 1 GROUP BY email, fecha_envio"),
    "visits": (("loaded",), """SELECT email, fecha_click AS fecha_visita, max(clicks) AS clicks,
        last(file_id ORDER BY id_ejecucion, file_id, line_no) AS file_id FROM loaded
        WHERE rn IS NOT NULL AND clicks > 0 AND fecha_click IS NOT NULL GROUP BY email, fecha_click"""),
    "visitors": (("visits",), """SELECT email, CAST(min(fecha_visita) AS DATE) AS "fechaPrimeraVisita",
        CAST(max(fecha_visita) AS DATE) AS "fechaUltimaVisita", CAST(sum(clicks) AS BIGINT) AS "visitasTotales",
        CAST(coalesce(sum(clicks) FILTER (WHERE year(fecha_visita) = 2024), 0) AS BIGINT) AS "visitasAnioActual",
        CAST(coalesce(sum(clicks) FILTER (WHERE year(fecha_visita) = 2024 AND month(fecha_visita) = 1), 0) AS BIGINT) AS "visitasMesActual"
        FROM visits GROUP BY email"""),
    "files": (("work",), """SELECT id_ejecucion, file_id, 'report_' || file_id || '.txt' AS nombre_archivo,
        sha256('report_' || file_id || '.txt') AS hash_archivo, CAST(sum(length(registro_completo)) AS BIGINT) AS bytes,
        count(*) AS registros_leidos, CASE WHEN file_id % 13 = 0 THEN 'RECHAZADO' WHEN file_id % 17 = 0 THEN 'CARGADO'
        WHEN file_id % 19 = 0 THEN 'RESPALDADO' ELSE 'PURGADO_ORIGEN' END AS estatus,
        CASE WHEN file_id % 13 = 0 THEN 'layout' ELSE '' END AS motivo_rechazo FROM work GROUP BY id_ejecucion, file_id"""),
    "runs": (("files", "ranked", "incidents"), """SELECT f.id_ejecucion, DATE '2024-01-01' + CAST(f.id_ejecucion - 1 AS INT) AS fecha_negocio,
        TIMESTAMP '2024-01-01 02:00:00' + to_days(CAST(f.id_ejecucion - 1 AS INT)) + to_minutes(f.id_ejecucion % 7) AS fecha_inicio,
        CASE WHEN f.id_ejecucion % 11 = 0 THEN 'FALLIDO' WHEN f.id_ejecucion % 13 = 0 THEN 'EN_CURSO'
             WHEN rej > 0 THEN 'OK_CON_ADVERTENCIAS' ELSE 'OK' END AS estatus,
        det AS archivos_detectados, CASE WHEN f.id_ejecucion % 9 = 0 THEN 0 ELSE don END AS archivos_cargados, rej AS archivos_rechazados,
        CASE WHEN f.id_ejecucion % 10 = 0 THEN 0 ELSE n END AS registros_leidos, kept AS registros_cargados,
        coalesce(err, 0) AS registros_error, coalesce(warn, 0) AS registros_advertencia, n // 10 + f.id_ejecucion % 5 AS duracion_segundos,
        CASE WHEN f.id_ejecucion % 11 = 0 THEN 'transform failed' ELSE '' END AS mensaje
        FROM (SELECT id_ejecucion, count(*) AS det, count(*) FILTER (WHERE estatus = 'PURGADO_ORIGEN') AS don,
                     count(*) FILTER (WHERE estatus = 'RECHAZADO') AS rej FROM files GROUP BY 1) f
        JOIN (SELECT id_ejecucion, count(*) AS n, count(*) FILTER (WHERE rn = 1) AS kept FROM ranked GROUP BY 1) w USING (id_ejecucion)
        LEFT JOIN (SELECT id_ejecucion, count(*) FILTER (WHERE severidad = 'RECHAZO') AS err,
                          count(*) FILTER (WHERE severidad = 'ADVERTENCIA') AS warn FROM incidents GROUP BY 1) i USING (id_ejecucion)"""),
    "catalogue": ((), "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in fixed.CATALOGUE)
        + ") AS t(codigo_error, rule_name, rule_severity, level, action)"),
    "rulings": ((), f"""SELECT event_id AS id_dictamen, CASE event_id % 5 WHEN 0 THEN 'baja_con_actividad' WHEN 1 THEN 'clic_sin_apertura'
        WHEN 2 THEN 'fecha_anterior_al_envio' WHEN 3 THEN 'badmail_con_actividad' ELSE 'otro' END AS tipo_caso,
        'user' || CASE WHEN event_id % 31 = 0 THEN user_id + 10000000 ELSE user_id END || '@mail' || (user_id % 7) || '.com' AS email,
        {_sent} AS fecha_envio, CASE event_id % 6 WHEN 0 THEN 'VALIDO' WHEN 1 THEN 'SOSPECHOSO' WHEN 2 THEN 'ERROR_DE_ORIGEN'
        WHEN 3 THEN 'REQUIERE_NEGOCIO' WHEN 4 THEN 'VALIDO' ELSE 'QUIZAS' END AS clasificacion,
        CASE WHEN event_id % 9 = 0 THEN 'too short' ELSE 'the evidence supports this class' END AS justificacion,
        CASE WHEN event_id % 37 = 0 THEN 1.5 ELSE CAST((event_id % 100) AS DOUBLE) / 100 END AS confianza
        FROM events"""),
    # --- route, media, staffing -----------------------------------------------------------
    "route_raw": ((), """SELECT CAST(year(ts) AS INT) AS anio, CAST(month(ts) AS INT) AS mes, ' Origin_' || (user_id % 3) || ' ' AS origen,
        'dest_' || (event_id % 4) AS destino, CAST(hour(ts) AS INT) AS hora_compra,
        CASE WHEN event_id % 9 <> 0 THEN CAST(hour(ts) + 1 AS INT) END AS hora_entrega,
        CASE WHEN event_id % 18 = 0 THEN 'CANCELLED' WHEN event_id % 27 <> 0 THEN 'DELIVERED' END AS ejecucion_entrega,
        CAST(event_type = 'purchase' AS INT) AS total_envios, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(1 + event_id % 3 AS INT) END AS visitas,
        CAST(event_type = 'purchase' AND value < 50 AS INT) AS entrega_a_tiempo,
        CAST(event_type = 'purchase' AND value >= 80 AS INT) AS entrega_demorada, event_id FROM events"""),
    "route": (("route_raw",), """SELECT * REPLACE (upper(trim(origen)) AS origen, upper(trim(destino)) AS destino) FROM route_raw
        WHERE anio = 2024 AND upper(trim(origen)) = 'ORIGIN_1' AND upper(trim(destino)) = 'DEST_2'"""),
    "media_raw": ((), """SELECT CAST(ts AS DATE) AS date, 'C' || (user_id % 5) AS campaign, event_type AS channel,
        CASE WHEN event_id % 31 <> 0 THEN CAST(value AS DECIMAL(12,2)) END AS spend,
        CASE WHEN event_id % 41 = 0 THEN 0 ELSE event_id % 1000 * 10 + 10 END AS impressions,
        CASE WHEN event_type = 'click' THEN event_id % 7 END AS clicks, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 END AS engagements,
        event_id % 4 AS link_clicks, CASE WHEN event_id % 6 <> 0 THEN event_id % 20 END AS video_views, event_id FROM events"""),
    "media": (("media_raw",), """SELECT date, strftime(date, '%Y-%m') AS month, campaign, channel, coalesce(spend, 0) AS spend, impressions,
        coalesce(clicks, 0) AS clicks, coalesce(engagements, 0) AS engagements, link_clicks, coalesce(video_views, 0) AS video_views,
        coalesce(clicks, 0) * 1.0 + coalesce(video_views, 0) * 0.1 + coalesce(engagements, 0) * 0.5 AS weighted_score FROM media_raw"""),
    "lanes": ((), """SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('purchase','signup') THEN 'NC' ELSE 'V2' END AS lane,
        CAST(hour(ts) AS INT) AS hour FROM events"""),
    "volume": (("lanes",), "SELECT day, lane, count(*) * 100 AS volume FROM lanes GROUP BY ALL"),
    "split": ((), """SELECT * FROM (VALUES ('V2','unload V2',1.0,120.0), ('V2','sorter',0.85,90.0), ('V2','sorter NC',0.15,40.0),
        ('NC','unload NC',1.0,35.0), ('NC','shipping',1.0,80.0)) AS t(lane, position, position_share, rate)"""),
    "curve": (("lanes", "split"), """SELECT position, hour, """ + r("CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY position)", 6) + """ AS hour_share
        FROM (SELECT lane, hour, count(*) AS n FROM lanes GROUP BY ALL) JOIN split USING (lane)"""),
    "headcount": (("volume", "split", "curve"), """SELECT day, lane, hour, position, CAST(ceil(round(volume * CAST(position_share AS DOUBLE)
        * hour_share / CAST(rate AS DOUBLE), 6)) AS BIGINT) AS people FROM volume JOIN split USING (lane) JOIN curve USING (position)"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` preceded by the named expressions and what they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body
