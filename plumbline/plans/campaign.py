"""Queries over campaign records: typing, rules, ranking, targets, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from ..functions import fixed
from ..operators import etl, profile, quality as q, rules
from ..session import scratch, write_once
from .oracle import CTES, r, sql
from .registry import query

_WORK = ("id_ejecucion, file_id, line_no, email, badmail, baja, fecha_envio, fecha_open, fecha_click, opens, opens_virales, clicks, "
         "clicks_virales, numericos_ok, email_ok, links, ips, navegadores, plataformas, registro_completo")


def _cols(text: str):
    return [c.strip() for c in text.split(",")]


# --- typed layer -----------------------------------------------------------------------------
@query(sql(f"SELECT {_WORK} FROM work", "work"))
def typed_records(x):
    return x.work.select(*_cols(_WORK))


@query(sql("SELECT file_id, line_no, coalesce(regexp_matches(trim(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$'), FALSE) AS strict, "
           "coalesce(regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), FALSE) AS loose FROM raw", "raw"))
def email_tests(x):
    return x.raw.select("file_id", "line_no", fx.email_ok("email").alias("strict"), fx.email_ok("email", strict=False).alias("loose"))


@query(sql("SELECT file_id, line_no, coalesce(try_strptime(fecha_envio, '%d/%m/%Y %H:%M'), try_strptime(fecha_envio, '%Y-%m-%d %H:%M')) AS sent FROM raw", "raw"))
def dates_in_several_formats(x):
    return x.raw.select("file_id", "line_no", fx.parse_any("fecha_envio", (fixed.SEND_FORMAT, "yyyy-M-d H:m")).alias("sent"))


@query(sql("SELECT file_id, line_no, split_part(registro_completo, ',', 1) AS first_field, regexp_matches(registro_completo, '(^|,)HARD(,|$)') AS hard, "
           "len(regexp_replace(registro_completo, '\"[^\"]*\"', '', 'g')) - len(replace(regexp_replace(registro_completo, '\"[^\"]*\"', '', 'g'), ',', '')) + 1 <> 15 AS bad_quoted, "
           "len(registro_completo) - len(replace(registro_completo, ',', '')) + 1 <> 15 AS bad_plain, left(registro_completo, 40) AS head FROM work", "work"))
def record_strings(x):
    rec = "registro_completo"
    return x.work.select("file_id", "line_no", fx.first_token(rec).alias("first_field"), fx.record_has_token(rec, "HARD").alias("hard"),
                         fx.bad_record_len(rec, 15).alias("bad_quoted"), fx.bad_record_len(rec, 15, quoted=False).alias("bad_plain"),
                         fx.truncate_text(rec, 40).alias("head"))


# --- checks over files -------------------------------------------------------------------------
@query(sql("SELECT column_name, with_cr FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE ends_with({c}, chr(13))) AS {c}" for c in ("navegadores", "plataformas"))
           + " FROM raw) UNPIVOT (with_cr FOR column_name IN (navegadores, plataformas))", "raw"))
def residual_carriage_returns(x):
    return q.residual_cr(x.raw, ["navegadores", "plataformas"])


_BAD = "coalesce({c}_txt,'') NOT IN ('','-') AND {c} IS NULL"


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM work" for n, c in {
    "open_before_send": "fecha_open < fecha_envio", "click_before_send": "fecha_click < fecha_envio", "click_before_open": "fecha_click < fecha_open",
    "bad_send": _BAD.format(c="fecha_envio"), "bad_open": _BAD.format(c="fecha_open"), "bad_click": _BAD.format(c="fecha_click")}.items()), "work"))
def date_order_anomalies(x):
    return q.date_order(x.work)


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim({c}) = '') AS empty, count(*) FILTER (WHERE trim({c}) = '-') AS dash, "
                              f"count(*) FILTER (WHERE trim({c}) NOT IN ('','-')) AS populated, count(DISTINCT CASE WHEN trim({c}) NOT IN ('','-') THEN trim({c}) END) AS distinct_values FROM raw"
                              for c in fixed.RAW_COLUMNS), "raw").replace("count(*) FILTER", "count(*) FILTER"))
def missing_value_forms(x):
    return profile.missing_forms(x.raw, fixed.RAW_COLUMNS)


@query(sql("SELECT id_ejecucion, file_id, campo FROM fileinc", "fileinc"))
def empty_columns_per_file(x):
    return q.empty_columns(x.work, fixed.EMPTY_CHECKED, ["id_ejecucion", "file_id"])


@query(sql("SELECT email, count(DISTINCT file_id) AS files, count(*) AS records, min(file_id) AS first_file, max(file_id) AS last_file, "
           "min((opens, clicks)) <> max((opens, clicks)) AS conflicting FROM work WHERE email_ok GROUP BY 1 HAVING count(DISTINCT file_id) > 1", "work"))
def emails_in_several_files(x):
    return q.cross_file_overlap(x.work.filter("email_ok"), ["email"], "file_id", ["opens", "clicks"])


@query(sql("SELECT email, fecha_envio, count(DISTINCT file_id) AS files, count(*) AS records, min(file_id) AS first_file, max(file_id) AS last_file, "
           "min((opens, clicks)) <> max((opens, clicks)) AS conflicting FROM work WHERE email_ok AND fecha_envio IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT file_id) > 1", "work"))
def sends_in_several_files(x):
    return q.cross_file_overlap(x.work.filter("email_ok AND fecha_envio IS NOT NULL"), ["email", "fecha_envio"], "file_id", ["opens", "clicks"])


@query(sql("SELECT a.email, a.o AS a_opens, a.c AS a_clicks, b.o AS b_opens, b.c AS b_clicks FROM "
           + " JOIN ".join(f"(SELECT email, arg_max(opens, (line_no, opens, clicks)) AS o, arg_max(clicks, (line_no, opens, clicks)) AS c FROM work WHERE email_ok AND file_id % 10 = {d} GROUP BY 1) {n}"
                           for n, d in (("a", 0), ("b", 1))) + " USING (email)", "work"))
def versions_in_two_sources(x):
    rows = x.work.filter("email_ok").withColumn("source", F.when(F.col("file_id") % 10 == 0, "a").when(F.col("file_id") % 10 == 1, "b"))
    return q.versions_side_by_side(rows, ["email"], "source", ["line_no"], ["opens", "clicks"], "a", "b")


# --- ranking and rules -----------------------------------------------------------------------------
@query(sql("SELECT id_ejecucion, file_id, line_no, email, CAST(rn AS INT) AS rn FROM ranked", "ranked"))
def ranked_sends(x):
    return x.ranked.select("id_ejecucion", "file_id", "line_no", "email", "rn")


@query(sql("SELECT id_ejecucion, file_id, line_no, codigo_error, severidad, campo, valor_original FROM incidents", "incidents"))
def load_incidents(x):
    return x.incidents.select("id_ejecucion", "file_id", "line_no", "codigo_error", "severidad", "campo", "valor_original")


_FACTS = """SELECT *, opens > 0 AS op, clicks > 0 AS cl, fecha_open IS NOT NULL AS od, fecha_click IS NOT NULL AS cd, links IS NOT NULL AS lk, ips IS NOT NULL AS ip,
    navegadores IS NOT NULL AS br, plataformas IS NOT NULL AS pl, badmail IS NOT NULL AS bad, coalesce(upper(baja) = 'SI', FALSE) AS baj,
    opens > 0 OR clicks > 0 AS eng, opens > 0 OR fecha_open IS NOT NULL AS opd, ips IS NULL AND navegadores IS NULL AND plataformas IS NULL AS nomd FROM work"""
CTES["facts"] = (("work",), _FACTS)

_MALFORMED = " OR ".join(f"(coalesce({c}_txt,'') NOT IN ('','-') AND NOT regexp_matches({c}_txt, '^[0-9]+$'))" for c in ("opens", "clicks"))
_BR = [
    ("001", "ERROR", "op AND NOT od"), ("002", "WARNING", "NOT op AND od"), ("003", "ERROR", "cl AND NOT cd"), ("004", "WARNING", "NOT cl AND cd"),
    ("005", "WARNING", "cl AND NOT op"), ("006", "WARNING", "fecha_click < fecha_open"), ("007", "WARNING", "lk AND NOT cl"), ("008", "WARNING", "cl AND NOT lk"),
    ("009", "WARNING", "opens_virales > opens"), ("010", "WARNING", "clicks_virales > clicks"), ("011", "WARNING", "bad AND eng"),
    ("012", "VALID", "baj AND eng"), ("013", "VALID", "baj AND cl"), ("014", "VALID", "baj AND op"), ("015", "UNKNOWN", "baj AND cd"), ("016", "UNKNOWN", "baj AND od"),
    ("017", "WARNING", "ip AND NOT opd"), ("018", "WARNING", "br AND NOT opd"), ("019", "WARNING", "pl AND NOT opd"), ("020", "WARNING", "nomd AND eng"),
    ("021", "WARNING", "op AND NOT ip"), ("022", "WARNING", "cl AND NOT ip"), ("024", "WARNING", "fecha_open < fecha_envio"), ("025", "WARNING", "fecha_click < fecha_envio"),
    ("026", "WARNING", "fecha_click < fecha_open"), ("027", "VALID", "fecha_open = fecha_envio"), ("028", "VALID", "fecha_click = fecha_open"),
    ("040", "ERROR", "email IS NULL"), ("041", "ERROR", "email IS NOT NULL AND NOT email_ok"), ("042", "ERROR", _MALFORMED),
    *[(code, "ERROR", _BAD.format(c=d)) for code in ("023", "043") for d in ("fecha_envio", "fecha_open", "fecha_click")],
]


@query(sql("SELECT codigo_error, severidad, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS lines FROM (" + " UNION ALL ".join(
    f"SELECT 'BR-{c}' AS codigo_error, '{s}' AS severidad, line_no FROM facts WHERE {w}" for c, s, w in _BR) + ") GROUP BY 1, 2", "facts"))
def business_rules_of_records(x):
    found = rules.apply_rules(x.work, rules.br_rules(), ["file_id", "line_no"])
    return found.groupBy("codigo_error", "severidad").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


CTES["per_email"] = (("work",), "SELECT email, count(*) AS n, count(DISTINCT file_id) AS files, count(DISTINCT fecha_envio) AS sends, "
                     "count(DISTINCT (opens, opens_virales, fecha_open, clicks, clicks_virales, fecha_click)) AS acts FROM work WHERE email IS NOT NULL GROUP BY 1")
CTES["per_send"] = (("work",), "SELECT email, fecha_envio, count(*) AS n, count(DISTINCT file_id) AS files, "
                    "count(DISTINCT (opens, opens_virales, fecha_open, clicks, clicks_virales, fecha_click)) AS acts FROM work WHERE email IS NOT NULL AND fecha_envio IS NOT NULL GROUP BY 1, 2")
CTES["per_record"] = (("work",), "SELECT registro_completo, count(*) AS n FROM work GROUP BY 1")
_REP = [("029", "WARNING", "e.n > 1"), ("030", "WARNING", "s.n > 1"), ("031", "WARNING", "r.n > 1"), ("032", "WARNING", "e.n > 1 AND e.acts > 1"),
        ("033", "WARNING", "e.files > 1"), ("034", "WARNING", "s.files > 1"), ("035", "VALID", "e.files > 1 AND e.sends > 1"),
        ("036", "WARNING", "s.files > 1 AND s.acts > 1"), ("044", "WARNING", "r.n > 1"), ("045", "WARNING", "s.n > 1")]


@query(sql("SELECT codigo_error, severidad, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS lines FROM (" + " UNION ALL ".join(
    f"SELECT 'BR-{c}' AS codigo_error, '{s}' AS severidad, line_no FROM work w LEFT JOIN per_email e USING (email) LEFT JOIN per_send s USING (email, fecha_envio) "
    f"LEFT JOIN per_record r USING (registro_completo) WHERE {cond}" for c, s, cond in _REP) + ") GROUP BY 1, 2", "per_email", "per_send", "per_record"))
def business_rules_of_repetition(x):
    # no rank is needed, and of the records only what repeats; read several times, so written
    records = write_once(x.work.select("file_id", "line_no", "email", "fecha_envio", *rules.INTERACTION, "registro_completo"), "records")
    found = rules.apply_rules(rules.with_repetition(records), rules.br_repetition_rules(), ["file_id", "line_no"])
    return found.groupBy("codigo_error", "severidad").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


_SCENARIOS = {
    "OPEN_NONE": "NOT op AND NOT od", "OPEN_COUNT_AND_DATE": "op AND od", "OPEN_COUNT_WITHOUT_DATE": "op AND NOT od", "OPEN_DATE_WITH_ZERO_COUNT": "NOT op AND od",
    "CLICK_NONE": "NOT cl AND NOT cd", "CLICK_COUNT_AND_DATE": "cl AND cd", "CLICK_COUNT_WITHOUT_DATE": "cl AND NOT cd", "CLICK_DATE_WITH_ZERO_COUNT": "NOT cl AND cd",
    "CLICK_WITHOUT_OPEN_COUNT": "cl AND NOT op", "CLICK_WITH_OPEN_COUNT": "cl AND op", "OPEN_WITHOUT_CLICK": "op AND NOT cl",
    "LINKS_WITH_CLICKS": "lk AND cl", "LINKS_WITHOUT_CLICKS": "lk AND NOT cl", "CLICK_WITHOUT_LINKS": "cl AND NOT lk",
    "VIRAL_OPENS_GREATER_THAN_OPENS": "opens_virales > opens", "VIRAL_CLICKS_GREATER_THAN_CLICKS": "clicks_virales > clicks",
    "VIRAL_OPENS_EQUAL_OPENS": "opens_virales = opens AND op", "VIRAL_CLICKS_EQUAL_CLICKS": "clicks_virales = clicks AND cl",
    "VIRAL_OPENS_LESS_THAN_OPENS": "opens_virales < opens", "VIRAL_CLICKS_LESS_THAN_CLICKS": "clicks_virales < clicks",
    "BAJA_WITHOUT_ENGAGEMENT": "baj AND NOT eng", "BAJA_WITH_ENGAGEMENT": "baj AND eng", "BAJA_WITH_CLICK": "baj AND cl", "BAJA_WITH_OPEN": "baj AND op",
    "NO_BAJA_WITH_ENGAGEMENT": "NOT baj AND eng", "BADMAIL_WITHOUT_ENGAGEMENT": "bad AND NOT eng", "BADMAIL_WITH_ENGAGEMENT": "bad AND eng",
    "NO_BADMAIL_WITH_ENGAGEMENT": "NOT bad AND eng", "METADATA_PRESENT": "NOT nomd", "METADATA_ABSENT": "nomd", "ALL_METADATA_ABSENT": "nomd",
    "IP_PRESENT": "ip", "BROWSER_PRESENT": "br", "PLATFORM_PRESENT": "pl", "FULL_METADATA": "ip AND br AND pl", "IP_ONLY": "ip AND NOT br AND NOT pl",
    "BROWSER_ONLY": "NOT ip AND br AND NOT pl", "PLATFORM_ONLY": "NOT ip AND NOT br AND pl", "IP_BROWSER_ONLY": "ip AND br AND NOT pl",
    "IP_PLATFORM_ONLY": "ip AND NOT br AND pl", "BROWSER_PLATFORM_ONLY": "NOT ip AND br AND pl",
    "OPEN_BEFORE_SEND": "fecha_open < fecha_envio", "OPEN_AT_SEND_TIME": "fecha_open = fecha_envio", "OPEN_AFTER_SEND": "fecha_open > fecha_envio",
    "CLICK_BEFORE_SEND": "fecha_click < fecha_envio", "CLICK_AT_SEND_TIME": "fecha_click = fecha_envio", "CLICK_AFTER_SEND": "fecha_click > fecha_envio",
    "CLICK_BEFORE_OPEN": "fecha_click < fecha_open", "CLICK_AT_OPEN_TIME": "fecha_click = fecha_open", "CLICK_AFTER_OPEN": "fecha_click > fecha_open",
    "CLICK_WITHOUT_ANY_OPEN_SIGNAL": "NOT op AND cl AND NOT od", "OPEN_AND_CLICK": "op AND cl", "OPEN_ONLY": "op AND NOT cl", "NO_RECORDED_ENGAGEMENT": "NOT op AND NOT cl",
    "COMPLETELY_INACTIVE": "NOT op AND NOT cl AND NOT od AND NOT cd", "COMPLETE_OPEN_CLICK_EVENT_DATA": "op AND cl AND od AND cd",
    "OPEN_EVENT_WITHOUT_CLICK": "op AND NOT cl AND od", "CLICK_EVENT_PRESENT": "cl AND cd",
}
_PER_FILE = " UNION ALL ".join(f"SELECT file_id, '{n}' AS label, count(*) AS records FROM facts WHERE {c} GROUP BY 1" for n, c in _SCENARIOS.items())


@query(sql(_PER_FILE, "facts"))
def scenario_counts_per_file(x):
    return rules.scenario_counts(x.work)


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS lines FROM facts WHERE {c} HAVING count(*) > 0" for n, c in _SCENARIOS.items()), "facts"))
def scenario_labels(x):
    return rules.scenario_labels(x.work).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


@query(sql("SELECT label, " + ", ".join(f"CAST(coalesce(sum(records) FILTER (WHERE file_id % 10 = {d}), 0) AS BIGINT) AS file_{d}" for d in (0, 1, 2)) + f" FROM ({_PER_FILE}) GROUP BY 1", "facts"))
def scenario_comparison(x):
    by_source = rules.scenario_counts(x.work).withColumn("source", F.col("file_id") % 10)
    return rules.scenario_matrix(by_source, "source", [0, 1, 2])


# --- targets -----------------------------------------------------------------------------------------
_STATS = "email, fecha_envio, opens, opens_virales, clicks, clicks_virales, fecha_open, fecha_click, links, ips, navegadores, plataformas, badmail, baja, file_id"


@query(sql(f"SELECT {_STATS} FROM stats", "stats"))
def upsert_statistics(x):
    return x.stats.select(*_cols(_STATS))


@query(sql(f"SELECT {_STATS} FROM stats", "stats"))
def upsert_in_two_steps(x):
    """Merging the first half and then the second gives the same target."""
    half = F.col("id_ejecucion") <= 15
    first = etl.statistics(x.loaded.filter(half), seq=x.SEQ)
    return etl.statistics(x.loaded.filter(~half), target=first, seq=x.SEQ).select(*_cols(_STATS))


@query(sql("SELECT email, fecha_envio, max(opens) AS opens, last(fecha_open ORDER BY id_ejecucion, file_id, line_no) FILTER (WHERE fecha_open IS NOT NULL) AS fecha_open, "
           "last(links ORDER BY id_ejecucion, file_id, line_no) FILTER (WHERE links IS NOT NULL) AS links FROM loaded WHERE rn = 1 GROUP BY 1, 2", "loaded"))
def upsert_keeping_known_values(x):
    return etl.statistics(x.loaded, seq=x.SEQ, keep_nulls=False).select("email", "fecha_envio", "opens", "fecha_open", "links")


@query(sql("SELECT email, fecha_visita, clicks, file_id FROM visits", "visits"))
def upsert_visits(x):
    return x.visits.select("email", "fecha_visita", "clicks", "file_id")


@query(sql("SELECT * FROM visitors", "visitors"))
def visitor_totals(x):
    return x.visitors


@query(sql("""SELECT * REPLACE (strftime("fechaPrimeraVisita", '%Y%m%d') AS "fechaPrimeraVisita", strftime("fechaUltimaVisita", '%Y%m%d') AS "fechaUltimaVisita") FROM visitors""", "visitors"))
def visitor_view(x):
    return etl.visitor_view(x.visitors)


# --- profiles --------------------------------------------------------------------------------------------
_ALL_FIELDS = ("email", "jyv", "badmail", "baja", "fecha_envio", "fecha_open", "opens", "opens_virales", "fecha_click", "clicks", "clicks_virales", "links", "ips",
               "navegadores", "plataformas")
_ABSENT = "('','-','NULL','null','N/A','n/a','NaN')"
CTES["melted"] = (("raw",), " UNION ALL ".join(f"SELECT {i + 1} AS position, '{c}' AS column_name, {c} AS value, {c} NOT IN {_ABSENT} AS p FROM raw" for i, c in enumerate(fixed.RAW_COLUMNS)))
_FMTS = [("%d/%m/%Y %H:%M", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$"), ("%d/%m/%Y", r"^\d{2}/\d{2}/\d{4}$"), ("%Y-%m-%d %H:%M:%S", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
         ("%Y-%m-%d %H:%M", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), ("%Y-%m-%d", r"^\d{4}-\d{2}-\d{2}$"), ("%m/%d/%Y %H:%M", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$")]
_FITS = ["bool_and(regexp_matches(value, '{p}') AND try_strptime(value, '{f}') IS NOT NULL) FILTER (WHERE p)".format(p=p, f=f) for f, p in _FMTS]
CTES["shapes"] = (("melted",), "SELECT position, column_name, count(*) AS rows, count(*) FILTER (WHERE p) AS present, count(DISTINCT value) FILTER (WHERE p) AS distinct_values, "
                  "bool_and(regexp_matches(value, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')) FILTER (WHERE p) OR "
                  "(count(*) FILTER (WHERE p AND value LIKE '%@%' AND NOT regexp_matches(value, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')) > 0 AND "
                  "count(*) FILTER (WHERE p AND value LIKE '%@%') > 0.8 * count(*) FILTER (WHERE p)) AS is_email, CASE "
                  + " ".join(f"WHEN {fit} THEN '{f}'" for fit, (f, _) in zip(_FITS, _FMTS)) + " END AS date_format, "
                  "bool_and(regexp_matches(value, '^-?\\d+$')) FILTER (WHERE p) AS is_int, bool_and(regexp_matches(value, '^-?\\d+([.,]\\d+)?$')) FILTER (WHERE p) AS is_dec "
                  "FROM melted GROUP BY 1, 2")
CTES["typed"] = (("shapes",), "SELECT position, column_name, present, rows, distinct_values, CASE WHEN present = 0 THEN 'vacia' WHEN is_email THEN 'email' WHEN date_format IS NOT NULL THEN 'fecha' "
                 "WHEN is_int THEN 'entero' WHEN is_dec THEN 'decimal' WHEN distinct_values <= 8 THEN 'categoria' ELSE 'texto' END AS type, date_format, "
                 + r("CAST(present AS DOUBLE) / rows * 100", 1) + " AS pct_present FROM shapes")


@query(sql("SELECT position, column_name, type, CASE WHEN type = 'fecha' THEN date_format END AS date_format, present FROM typed", "typed"))
def inferred_types(x):
    return profile.infer_types(x.raw, fixed.RAW_COLUMNS)


@query(sql("SELECT column_name, rows, present, distinct_values, pct_present, type FROM typed", "typed"))
def column_profiles(x):
    return profile.profile_columns(x.raw, fixed.RAW_COLUMNS).select("column_name", "rows", "present", "distinct_values", "pct_present", "type")


@query(sql("SELECT 'V-' || lpad(CAST(row_number() OVER (ORDER BY position) + 2 AS VARCHAR), 2, '0') AS code, column_name, CASE type WHEN 'email' THEN 'well-formed address' "
           "WHEN 'fecha' THEN 'date as ' || date_format WHEN 'vacia' THEN 'column is empty' ELSE 'is a number' END AS rule, "
           "CASE WHEN type = 'email' OR (type = 'fecha' AND pct_present > 95) THEN 'RECHAZO' ELSE 'ADVERTENCIA' END AS severity FROM typed "
           "WHERE type IN ('email','fecha','entero','decimal','vacia')", "typed"))
def proposed_validations(x):
    return profile.propose_rules(profile.profile_columns(x.raw, fixed.RAW_COLUMNS))


_KEYCOLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _keys_sql(table, cols):
    singles = [f"SELECT '{c}' AS columns, 1 AS n_columns, count(*) AS total, count(DISTINCT CAST({c} AS VARCHAR)) AS d FROM {table}" for c in cols]
    pairs = [f"SELECT '{a} + {b}' AS columns, 2 AS n_columns, count(*) AS total, count(DISTINCT (CAST({a} AS VARCHAR), CAST({b} AS VARCHAR))) AS d FROM {table}" for i, a in enumerate(cols) for b in cols[i + 1:]]
    return ("WITH s AS (" + " UNION ALL ".join(singles) + "), p AS (" + " UNION ALL ".join(pairs) + ") SELECT columns, n_columns, " + r("CAST(d AS DOUBLE) / total", 4)
            + " AS uniqueness, total - d AS duplicates FROM (SELECT * FROM s WHERE d > 0.5 * total UNION ALL SELECT p.* FROM p JOIN s a ON a.columns = split_part(p.columns, ' + ', 1) "
            "JOIN s b ON b.columns = split_part(p.columns, ' + ', 2) WHERE a.d > 0.1 * a.total AND b.d > 0.1 * b.total AND p.d > 0.9 * p.total) ORDER BY uniqueness DESC, n_columns, columns LIMIT 6")


@query(_keys_sql("customer", _KEYCOLS))
def key_candidates(x):
    return profile.key_candidates(x.table("customer"), _KEYCOLS)


@query(sql("SELECT column_name, string_agg(value, ' ; ' ORDER BY rn) AS examples FROM (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY line_no, file_id) AS rn FROM ("
           + " UNION ALL ".join(f"SELECT file_id, line_no, '{c}' AS column_name, {c} AS value FROM raw WHERE {c} NOT IN {_ABSENT}" for c in _ALL_FIELDS)
           + ")) WHERE rn <= 3 GROUP BY 1", "raw"))
def column_examples(x):
    out = profile.column_examples(x.raw, ["line_no", "file_id"], list(_ALL_FIELDS))
    return out.select("column_name", F.array_join("examples", " ; ").alias("examples"))


@query("SELECT doc_id, CAST(3 AS INT) AS fields, FALSE AS bad, CAST(length(t) AS INT) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS t FROM documents)")
def long_quoted_fields(x):
    """Whole documents as one quoted field of a delimited line, read back."""
    from ..sources import files
    plain = x.table("documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("t"))
    line = F.concat(F.col("doc_id"), F.lit(',"'), F.replace("t", F.lit('"'), F.lit('""')), F.lit('",end'))
    cut = plain.select("doc_id", line.alias("line")).select("doc_id", "line", files.split_fields("line").alias("f"))
    return cut.select("doc_id", files.field_count("line").cast("int").alias("fields"), fx.bad_record_len("line", 3).alias("bad"),
                      F.length(F.get("f", 1)).alias("chars"), F.md5(F.get("f", 1).cast("binary")).alias("digest"))


# --- the load as a file stream --------------------------------------------------------------------------
CTES["one_batch"] = (("work",), "SELECT *, CASE WHEN email_ok AND fecha_envio IS NOT NULL THEN row_number() OVER (PARTITION BY email, fecha_envio, "
                     "(email_ok AND fecha_envio IS NOT NULL) ORDER BY opens DESC, clicks DESC, line_no DESC) END AS rn FROM work")


@query(sql("SELECT 'statistics' AS target, count(*) AS rows, CAST(sum(opens) AS BIGINT) AS opens, CAST(sum(clicks) AS BIGINT) AS clicks FROM one_batch WHERE rn = 1 UNION ALL "
           "SELECT 'visits', count(*), CAST(0 AS BIGINT), CAST(sum(c) AS BIGINT) FROM (SELECT email, fecha_click, max(clicks) AS c FROM one_batch WHERE rn IS NOT NULL AND clicks > 0 AND fecha_click IS NOT NULL GROUP BY 1, 2) "
           "UNION ALL SELECT 'rejected', count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM one_batch WHERE rn IS NULL", "one_batch"))
def streamed_ingest(x):
    """Write the campaign files, ingest them as a stream, read the targets."""
    from ..streaming import ingest
    root = scratch(x.spark, "stream")
    headed = x.raw.select("file_id", *[F.regexp_replace(c, "\r", "").alias(h) for c, h in fixed.LAYOUT])
    headed.repartition("file_id").write.partitionBy("file_id").option("header", True).option("emptyValue", "").csv(f"{root}/in")
    ingest.ingest_stream(x.spark, f"{root}/in/*", f"{root}/out", f"{root}/ckpt", pattern="*.csv").awaitTermination()
    zero = F.lit(0).cast("long")
    stats = ingest.current(x.spark, f"{root}/out", "statistics").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("opens").alias("opens"), F.sum("clicks").alias("clicks")).select(F.lit("statistics").alias("target"), "rows", "opens", "clicks")
    visits = ingest.current(x.spark, f"{root}/out", "visits").agg(F.count(F.lit(1)).alias("rows"), F.sum("clicks").alias("clicks")).select(
        F.lit("visits").alias("target"), "rows", zero.alias("opens"), "clicks")
    said = ingest.current(x.spark, f"{root}/out", "incidents").filter(F.col("severidad") == fixed.REJECT).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("rejected").alias("target"), "rows", zero.alias("opens"), zero.alias("clicks"))
    return stats.unionByName(visits).unionByName(said)
