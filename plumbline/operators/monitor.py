"""Run, file and incident monitoring; reconciliation; ambiguous cases; rulings.

Everything works on all runs at once; filter the result for one run. Counts per
file or run are aggregated before they are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bad_record_len, exact_round, first_token, fixed, month_label, parse_any, record_has_token, safe_ratio
from .quality import stack_checks


def _count_by(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_counts(df: DataFrame, rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add how many of ``rows`` belong to each row (zero included)."""
    counted = _count_by(rows, keys, name)
    return df.join(counted, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


# --- catalogue --------------------------------------------------------------------------
def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.CATALOGUE), "codigo_error string, rule_name string, rule_severity string, level string, action string")


def with_catalogue(incidents: DataFrame, cat: DataFrame) -> DataFrame:
    return incidents.join(cat, "codigo_error", "left")


def catalogue_usage(cat: DataFrame, incidents: DataFrame) -> DataFrame:
    return with_counts(cat, incidents, ["codigo_error"], "times_seen").select(
        "codigo_error", "rule_name", "rule_severity", "level", "times_seen")


# --- incidents ---------------------------------------------------------------------------
def incident_summary(incidents: DataFrame, cat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = incidents.groupBy(*by, "codigo_error", "severidad").agg(F.count(F.lit(1)).alias("total"))
    return with_catalogue(counts, cat).select(*by, "codigo_error", "rule_name", "severidad", "total")


def daily_quality(incidents: DataFrame, runs: DataFrame, cat: DataFrame) -> DataFrame:
    """Incidents and affected files per business date and rule. Rows are reduced
    to (run, file, rule) before they meet the runs."""
    per_file = incidents.groupBy("id_ejecucion", "file_id", "codigo_error", "severidad").agg(
        F.count(F.lit(1)).alias("n"))
    dated = per_file.join(runs.select("id_ejecucion", "fecha_negocio"), "id_ejecucion")
    per_day = dated.groupBy("fecha_negocio", "codigo_error", "severidad").agg(
        F.sum("n").alias("incidencias"), F.countDistinct("file_id").alias("archivos_afectados"))
    return with_catalogue(per_day, cat).select(
        "fecha_negocio", "codigo_error", "rule_name", "severidad", "incidencias", "archivos_afectados")


def incident_view(incidents: DataFrame, runs: DataFrame, cat: DataFrame, run: int | None = None,
                  code: str | None = None, severity: str | None = None, raw_record: bool = False) -> DataFrame:
    """Incidents with business date, rule name and action; optional filters."""
    for col, value in (("id_ejecucion", run), ("codigo_error", code), ("severidad", severity)):
        if value is not None:
            incidents = incidents.filter(F.col(col) == value)
    joined = with_catalogue(incidents.join(runs.select("id_ejecucion", "fecha_negocio"), "id_ejecucion"), cat)
    cols = ["fecha_negocio", "id_ejecucion", "file_id", "line_no", "codigo_error", "rule_name", "action", "severidad",
            "campo", "valor_original"]
    return joined.select(*cols, *(["registro_completo"] if raw_record else []))


# --- runs ----------------------------------------------------------------------------------
def run_health(runs: DataFrame) -> DataFrame:
    """Traffic light and error rates of each run. A run that read nothing has no
    rate: comparisons with it are unknown and fall to the next test."""
    read, errors = F.col("registros_leidos"), F.col("registros_error")
    light = (
        F.when(F.col("estatus") == fixed.RUN_FAILED, fixed.LIGHT_RED)
        .when(errors > F.lit(fixed.REJECT_RATE_LIMIT) * F.nullif(read, F.lit(0)), fixed.LIGHT_RED)
        .when((F.col("archivos_rechazados") > 0) | (errors > 0), fixed.LIGHT_AMBER).otherwise(fixed.LIGHT_GREEN)
    )
    return runs.withColumns({
        "pct_error": exact_round(safe_ratio(errors, read, 100), 2),
        "pct_advertencia": exact_round(safe_ratio("registros_advertencia", read, 100), 2),
        "semaforo": light,
    })


def monthly_report(runs: DataFrame) -> DataFrame:
    totals = runs.groupBy(month_label("fecha_negocio").alias("periodo")).agg(
        F.count(F.lit(1)).alias("corridas"), F.count_if(F.col("estatus") == fixed.RUN_FAILED).alias("corridas_fallidas"),
        *[F.sum(c).alias(c) for c in ("archivos_cargados", "archivos_rechazados", "registros_leidos",
                                      "registros_cargados", "registros_error")],
        exact_round(F.avg("duracion_segundos"), 1).alias("duracion_promedio_seg"))
    return totals.withColumn("pct_exito", exact_round(safe_ratio("registros_cargados", "registros_leidos", 100), 2))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("id_ejecucion") == runs.agg(F.max("id_ejecucion").alias("m")).scalar())


def freshness(runs: DataFrame, as_of: str, hours: int = fixed.FRESH_HOURS) -> DataFrame:
    """Whole hours since the latest run began, and whether that is too long."""
    since = F.timestamp_diff("HOUR", F.col("fecha_inicio"), F.lit(as_of).cast("timestamp_ntz"))
    return latest_run(runs).select("id_ejecucion", "fecha_inicio", since.alias("hours_since_start"),
                                   F.when(since > hours, "STALE").otherwise("FRESH").alias("freshness"))


def list_runs(runs: DataFrame, status: str | None = None, light: str | None = None) -> DataFrame:
    out = run_health(runs)
    for col, value in (("estatus", status), ("semaforo", light)):
        if value is not None:
            out = out.filter(F.col(col) == value)
    return out


def list_files(files: DataFrame, target: DataFrame, incidents: DataFrame, status: str | None = None) -> DataFrame:
    rows = files if status is None else files.filter(F.col("estatus") == status)
    rejected = incidents.filter(F.col("severidad") == fixed.REJECT)
    return with_counts(with_counts(rows, target, ["file_id"], "en_destino"), rejected, ["file_id"], "rechazados")


def stuck_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("estatus").isin(*fixed.FILE_IN_BETWEEN))


def run_detail(run: int, runs: DataFrame, files: DataFrame, target: DataFrame, incidents: DataFrame, cat: DataFrame
               ) -> dict[str, DataFrame]:
    mine = F.col("id_ejecucion") == run
    return {"run": run_health(runs.filter(mine)), "files": list_files(files.filter(mine), target, incidents),
            "incidents": incident_summary(incidents.filter(mine), cat)}


def run_metrics(ranked: DataFrame, incidents: DataFrame, rejected_files: DataFrame | None = None) -> DataFrame:
    """Rows read, kept, rejected and warned about per run, and its status."""
    work = ranked.groupBy("id_ejecucion").agg(
        F.count(F.lit(1)).alias("registros_leidos"), F.count_if(F.col("rn") == 1).alias("registros_cargados"))
    said = incidents.groupBy("id_ejecucion").agg(
        F.count_if(F.col("severidad") == fixed.REJECT).alias("registros_error"),
        F.count_if(F.col("severidad") == fixed.WARN).alias("registros_advertencia"))
    out = work.join(said, "id_ejecucion", "left").fillna(0, ["registros_error", "registros_advertencia"])
    if rejected_files is None:
        return out.withColumns({"archivos_rechazados": F.lit(0).cast("long"), "estatus": F.lit(fixed.RUN_OK)})
    out = with_counts(out, rejected_files, ["id_ejecucion"], "archivos_rechazados")
    return out.withColumn("estatus", F.when(F.col("archivos_rechazados") > 0, fixed.RUN_WARN).otherwise(fixed.RUN_OK))


# --- diagnosis --------------------------------------------------------------------------------
GRAVITY = {"critico": 0, "alto": 1, "medio": 2, "bajo": 3}


def diagnose(runs: DataFrame, files: DataFrame, target: DataFrame, incidents: DataFrame) -> DataFrame:
    """Findings over all runs: what failed, what is stuck or lost, and what only
    shows when tables are crossed. ``subject`` is the file, where there is one."""
    status, file_status = F.col("estatus"), F.col("estatus")

    def finding(df: DataFrame, gravity: str, code: str, evidence: dict[str, Column], subject: Column | None = None):
        pairs = [x for k, v in evidence.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
        return df.select(
            "id_ejecucion", F.lit(gravity).alias("gravity"), F.lit(code).alias("finding"),
            (subject if subject is not None else F.lit("")).alias("subject"), F.create_map(*pairs).alias("evidence"))

    # files that were read and removed from the source, but own no row of the target
    gone = with_counts(files.filter((file_status == fixed.FILE_DONE) & (F.col("registros_leidos") > 0)),
                       target, ["file_id"], "en_destino").filter("en_destino = 0")
    gone = gone.join(runs.select("id_ejecucion", F.col("estatus").alias("_run_status")), "id_ejecucion")
    failed_run = F.col("_run_status") == fixed.RUN_FAILED
    name, read, errors = F.col("nombre_archivo"), F.col("registros_leidos"), F.col("registros_error")
    short = (incidents.filter(F.col("registro_completo").isNotNull()).groupBy("id_ejecucion").agg(
        F.count(F.lit(1)).alias("audited"),
        F.count_if(bad_record_len("registro_completo", len(fixed.LAYOUT))).alias("incomplete"))
        .filter("incomplete > 0"))
    seen = {"registros_leidos": read}
    found = stack_checks([
        finding(runs.filter(status == fixed.RUN_FAILED), "critico", "run_failed", {"mensaje": F.col("mensaje")}),
        finding(gone.filter(failed_run), "critico", "purged_not_loaded", seen, name),
        finding(gone.filter(~failed_run), "medio", "lineage_absorbed", seen, name),
        finding(stuck_files(files), "alto", "file_stuck", {"estatus": file_status}, name),
        finding(files.filter(file_status == fixed.FILE_REJECTED), "alto", "file_rejected",
                {"motivo": F.col("motivo_rechazo")}, name),
        finding(runs.filter((read > 0) & (errors / read > fixed.REJECT_RATE_LIMIT)), "alto", "reject_rate",
                {**seen, "registros_error": errors}),
        finding(runs.filter((F.col("archivos_detectados") > 0) & (F.col("archivos_cargados") == 0)), "medio",
                "nothing_loaded", {"detectados": F.col("archivos_detectados")}),
        finding(runs.filter(status == fixed.RUN_OPEN), "alto", "still_running", {"inicio": F.col("fecha_inicio")}),
        finding(short, "alto", "audit_incomplete", {"audited": F.col("audited"), "incomplete": F.col("incomplete")}),
    ])
    rank = F.create_map(*[F.lit(x) for kv in GRAVITY.items() for x in kv])
    return found.withColumn("gravity_rank", rank[F.col("gravity")])


# --- reconciliation -----------------------------------------------------------------------------
def layer_counts(layers: dict[str, DataFrame], visits: DataFrame) -> DataFrame:
    """Rows per layer, and the clicks behind the visits."""
    rows = [df.agg(F.count(F.lit(1)).alias("registros")).select(F.lit(n).alias("capa"), "registros")
            for n, df in layers.items()]
    clicks = visits.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("registros")).select(
        F.lit("sum of clicks").alias("capa"), "registros")
    return stack_checks([*rows, clicks])


def file_balance(files: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per file: read, in the work layer, kept, discarded, rejected."""
    rn = F.col("rn")
    work = ranked.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("en_trabajo"), F.count_if(rn == 1).alias("seleccionados"),
        F.count_if(rn > 1).alias("descartados_dup"), F.count_if(rn.isNull()).alias("rechazados"))
    cols = ["en_trabajo", "seleccionados", "descartados_dup", "rechazados"]
    return files.select("file_id", "nombre_archivo", F.col("registros_leidos").alias("leidos")).join(
        work, "file_id", "left").fillna(0, cols)


def balance(staged: DataFrame, ranked: DataFrame, incidents: DataFrame, by: Sequence[str] = ("id_ejecucion",)
            ) -> DataFrame:
    """Staged rows = kept + rejected + discarded, per run; record-level rejects
    only, and only those of the run."""
    a = staged.groupBy(*by).agg(F.count(F.lit(1)).alias("staged"))
    b = ranked.groupBy(*by).agg(F.count_if(F.col("rn") == 1).alias("kept"), F.count_if(F.col("rn") > 1).alias("discarded"))
    c = incidents.filter((F.col("severidad") == fixed.REJECT) & F.col("line_no").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rejected"))
    out = a.join(b, list(by), "left").join(c, list(by), "left").fillna(0)
    return out.withColumn("status", F.when(
        F.col("staged") == F.col("kept") + F.col("discarded") + F.col("rejected"), "PASS").otherwise("FAIL"))


def _checks(rows: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each check is a one-row frame with the number of violations ``v``."""
    out = stack_checks([df.select(F.lit(n).alias("check"), F.coalesce(F.col("v"), F.lit(0)).cast("long").alias("value"))
                        for n, df in rows])
    return out.withColumn("status", F.when(F.col("value") == 0, "PASS").otherwise("FAIL"))


def _violations(df: DataFrame, cond: Column) -> DataFrame:
    return df.agg(F.count_if(cond).alias("v"))


def _difference(a: DataFrame, b: DataFrame) -> DataFrame:
    sides = stack_checks([a.agg(F.count(F.lit(1)).alias("v")), b.agg((-F.count(F.lit(1))).alias("v"))])
    return sides.agg(F.sum("v").alias("v"))


def control_points(staged: DataFrame, ranked: DataFrame, files: DataFrame, incidents: DataFrame) -> DataFrame:
    """Staging equals work; each file has the rows read; every discarded
    duplicate is audited; no text ends in a carriage return."""
    loaded = _count_by(ranked, ["file_id"], "_n")
    off = files.join(loaded, "file_id").filter("_n <> registros_leidos")
    cr = F.col("plataformas").endswith("\r").cast("int") + F.col("navegadores").endswith("\r").cast("int")
    return _checks([
        ("staging = work", _difference(staged, ranked)),
        ("rows per file", off.agg(F.count(F.lit(1)).alias("v"))),
        ("discards audited", _difference(ranked.filter("rn > 1"), incidents.filter("codigo_error = 'V-07'"))),
        ("line ends", ranked.agg(F.sum(F.coalesce(cr, F.lit(0))).alias("v"))),
    ])


def target_integrity(stats: DataFrame, visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """Null keys, visitors without visits, inverted dates, lost visitors."""
    emails = visits.select("email").distinct()
    return _checks([
        ("null keys", _violations(stats, F.col("email").isNull() | F.col("fecha_envio").isNull())),
        ("visitor without visits", _violations(visitors, F.col("visitasTotales") <= 0)),
        ("inverted dates", _violations(visitors, F.col("fechaPrimeraVisita") > F.col("fechaUltimaVisita"))),
        ("emails = visitors", _difference(emails, visitors)),
    ])


def _totals_differ(visits: DataFrame, visitors: DataFrame) -> DataFrame:
    sums = visits.groupBy("email").agg(F.sum("clicks").alias("_clicks"))
    return _violations(visitors.join(sums, "email"), F.col("visitasTotales") != F.col("_clicks"))


def _repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _violations(_count_by(df, keys, "_n"), F.col("_n") > 1)


def assertions(stats: DataFrame, visits: DataFrame, visitors: DataFrame, files: DataFrame) -> DataFrame:
    """PASS/FAIL per assertion on the targets."""
    c = F.col
    known = visits.join(stats.select("email").distinct(), "email", "left_anti")
    lost = visits.join(files.select("file_id"), "file_id", "left_anti")
    return _checks([
        ("P-02 clean emails", _violations(visitors, ~c("email").rlike(fixed.EMAIL))),
        ("P-03 visit has statistics", known.agg(F.count(F.lit(1)).alias("v"))),
        ("P-03b visit has a date", _violations(visits, c("fecha_visita").isNull())),
        ("P-03c visit unique", _repeated(visits, ["email", "fecha_visita"])),
        ("P-04 totals = clicks", _totals_differ(visits, visitors)),
        ("P-05 dates ordered", _violations(visitors, c("fechaPrimeraVisita") > c("fechaUltimaVisita"))),
        ("P-06 month <= year <= total", _violations(visitors, (c("visitasMesActual") > c("visitasAnioActual"))
                                                    | (c("visitasAnioActual") > c("visitasTotales")))),
        ("P-07 visitor unique", _repeated(visitors, ["email"])),
        ("P-08 hash unique", _repeated(files, ["hash_archivo"])),
        ("P-09 file exists", lost.agg(F.count(F.lit(1)).alias("v"))),
    ])


def invariants(ranked: DataFrame, visits: DataFrame, visitors: DataFrame) -> DataFrame:
    """What must hold between the work layer and the targets, whichever way they
    were computed."""
    c = F.col
    kept = ranked.filter("rn IS NOT NULL")
    sends = kept.select("id_ejecucion", "email", "fecha_envio").distinct()
    clicked = kept.filter("clicks > 0 AND fecha_click IS NOT NULL")
    return _checks([
        ("one kept row per send", _difference(ranked.filter("rn = 1"), sends)),
        ("rank starts at 1", _violations(ranked, c("rn") < 1)),
        ("visit per click instant", _difference(clicked.select("email", "fecha_click").distinct(), visits)),
        ("visitor per email", _difference(visits.select("email").distinct(), visitors)),
        ("totals = clicks", _totals_differ(visits, visitors)),
        ("dates ordered", _violations(visitors, c("fechaPrimeraVisita") > c("fechaUltimaVisita"))),
    ])


def reconcile(staged: DataFrame, ranked: DataFrame, files: DataFrame, incidents: DataFrame, stats: DataFrame,
              visits: DataFrame, visitors: DataFrame) -> dict[str, DataFrame]:
    """Layer counts, per-file balance and all control points with one verdict."""
    totals = _checks([("totals = clicks", _totals_differ(visits, visitors))])
    controls = stack_checks([control_points(staged, ranked, files, incidents),
                             target_integrity(stats, visits, visitors), totals])
    return {
        "layers": layer_counts({"staging": staged, "work": ranked, "statistics": stats, "visits": visits,
                                "visitors": visitors}, visits),
        "files": file_balance(files, ranked), "controls": controls,
        "verdict": controls.agg(F.bool_and(F.col("status") == "PASS").alias("all_ok")),
    }


# --- ambiguous cases ---------------------------------------------------------------------------
CASE_KINDS = ("badmail_con_actividad", "badmail_perdido_en_dedupe", "fecha_anterior_al_envio",
              "virales_mayor_que_total", "baja_con_actividad", "clic_sin_apertura")


def ambiguous_cases(stats: DataFrame, incidents: DataFrame, kinds: Sequence[str] = CASE_KINDS,
                    flag_values: Sequence[str] | None = None) -> DataFrame:
    """Records where the business rule is open. By default any mark counts as
    flagged; ``flag_values`` narrows it to the words that mean yes. A send whose
    address lost a bounce mark in deduplication appears once, with the number of
    discarded rows: pairing both sides would square a busy address."""
    unknown = set(kinds) - set(CASE_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    c = F.col
    def flagged(name: str) -> Column:
        return c(name).isNotNull() if flag_values is None else F.coalesce(c(name).isin(*flag_values), F.lit(False))
    active = (c("opens") > 0) | (c("clicks") > 0)
    early = F.timestamp_diff("MINUTE", c("fecha_envio"), c("fecha_open"))
    tests = {
        "badmail_con_actividad": flagged("badmail") & active,
        "fecha_anterior_al_envio": c("fecha_open") < c("fecha_envio"),
        "virales_mayor_que_total": (c("opens_virales") > c("opens")) | (c("clicks_virales") > c("clicks")),
        "baja_con_actividad": flagged("baja") & active,
        "clic_sin_apertura": (c("clicks") > 0) & c("fecha_open").isNull(),
    }
    shown = ["email", "fecha_envio", "opens", "clicks"]
    hits = [F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items() if k in kinds]
    parts = []
    if hits:
        parts.append(stats.select(*shown, early.alias("_early"), F.explode(F.array(*hits)).alias("kind")).filter("kind IS NOT NULL")
                     .withColumns({"minutes": F.when(c("kind") == "fecha_anterior_al_envio", c("_early")),
                                   "discarded": F.lit(None).cast("long")}).drop("_early"))
    if "badmail_perdido_en_dedupe" in kinds:
        dropped = incidents.filter((c("codigo_error") == "V-07") & record_has_token("registro_completo", "HARD")).select(
            F.lower(F.trim(first_token("registro_completo"))).alias("email")).groupBy("email").agg(F.count(F.lit(1)).alias("discarded"))
        lost = stats.filter(active).select(*shown).join(dropped, "email")
        parts.append(lost.select(*shown, F.lit("badmail_perdido_en_dedupe").alias("kind"),
                                 F.lit(None).cast("long").alias("minutes"), "discarded"))
    return stack_checks(parts)


def lost_bounce_marks(stats: DataFrame, incidents: DataFrame) -> DataFrame:
    """The evidence behind ``badmail_perdido_en_dedupe``, to rule on: every discarded row with a bounce mark (file, line, record) beside what the target says of
    that very send. A row meets one send, so a busy address costs one row per discarded row."""
    c = F.col
    sent = F.regexp_extract("valor_original", r" \| (.*)$", 1)
    dropped = incidents.filter((c("codigo_error") == "V-07") & record_has_token("registro_completo", "HARD")).select(
        F.lower(F.trim(first_token("registro_completo"))).alias("email"), parse_any(sent).alias("fecha_envio"), "file_id", "line_no", c("registro_completo").alias("discarded"))
    shown = stats.filter((c("opens") > 0) | (c("clicks") > 0)).select("email", "fecha_envio", F.coalesce("badmail", F.lit("(none)")).alias("mark_in_target"), "opens", "clicks")
    return dropped.join(shown, ["email", "fecha_envio"])


def pending_cases(cases: DataFrame, rulings: DataFrame) -> DataFrame:
    """Cases nobody has ruled on."""
    done = rulings.select(F.col("tipo_caso").alias("kind"), "email", "fecha_envio").distinct()
    return cases.join(done, ["kind", "email", "fecha_envio"], "left_anti")


def register_rulings(rulings: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split proposed rulings into accepted and rejected, with the reason."""
    known = stats.select("email", "fecha_envio").distinct().withColumn("_hit", F.lit(True))
    c = F.col
    reason = (
        F.when(~F.coalesce(c("tipo_caso").isin(*CASE_KINDS), F.lit(False)), "unknown kind")
        .when(~F.coalesce(c("clasificacion").isin(*fixed.RULING_CLASSES), F.lit(False)), "unknown class")
        .when(F.coalesce(F.length(F.trim("justificacion")), F.lit(0)) < 20, "justification too short")
        .when(~F.coalesce(c("confianza").between(0, 1), F.lit(False)), "confidence out of range")
        .when(c("_hit").isNull(), "no such record")
    )
    judged = rulings.join(known, ["email", "fecha_envio"], "left").withColumn("reason", reason).drop("_hit")
    accepted = judged.filter("reason IS NULL").drop("reason").withColumn("confianza", c("confianza").cast("decimal(3,2)"))
    return accepted, judged.filter("reason IS NOT NULL")


def ruling_summary(rulings: DataFrame) -> DataFrame:
    return rulings.groupBy("clasificacion").agg(
        F.count(F.lit(1)).alias("n"), exact_round(F.avg("confianza"), 2).alias("mean_confidence"))


def list_rulings(rulings: DataFrame, kind: str | None = None, cls: str | None = None) -> DataFrame:
    for col, value in (("tipo_caso", kind), ("clasificacion", cls)):
        if value is not None:
            rulings = rulings.filter(F.col(col) == value)
    return rulings
