"""Rule engine and the rule sets over typed campaign records.

A rule is a code, a severity, a field, a condition and the value to keep as
evidence. All rules of a set are evaluated in one pass over the rows, whatever
their number; a row yields one finding per rule it meets.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blank_to_null, fixed, truncate_text
from ..session import write_once
from .quality import empty_columns

EVIDENCE = 500


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    field: str
    when: Column
    value: Column


def apply_rules(df: DataFrame, rules: Iterable[Rule], carry: Sequence[str]) -> DataFrame:
    """One row per (record, rule met), with the carried lineage columns."""
    hits = [
        F.when(F.coalesce(r.when, F.lit(False)), F.struct(
            F.lit(r.code).alias("codigo_error"), F.lit(r.severity).alias("severidad"),
            F.lit(r.field).alias("campo"), truncate_text(r.value.cast("string"), EVIDENCE).alias("valor_original")))
        for r in rules
    ]
    # exploding the literal array keeps the conditions in one place of the plan
    found = df.select(*carry, F.explode(F.array(*hits)).alias("_h"))
    return found.filter("_h IS NOT NULL").select(*carry, "_h.*")


def v_rules() -> list[Rule]:
    """Load-time validation of records. Rejections do not look at the rank."""
    c, kept = F.col, F.col("rn") == 1
    def text(name: str) -> Column:
        return F.coalesce(c(name), F.lit(""))
    def unread(date: str) -> Column:
        return kept & c(date).isNull() & blank_to_null(f"{date}_txt").isNotNull()
    return [
        Rule("V-03", fixed.REJECT, "email", ~c("email_ok"), c("email_original")),
        Rule("V-04", fixed.REJECT, "Fecha envio", c("email_ok") & c("fecha_envio").isNull(), c("fecha_envio_txt")),
        Rule("V-05", fixed.WARN, "Fecha open", unread("fecha_open"), c("fecha_open_txt")),
        Rule("V-05", fixed.WARN, "Fecha click", unread("fecha_click"), c("fecha_click_txt")),
        Rule("V-06", fixed.WARN, "Opens / Clicks", kept & ~c("numericos_ok"), c("registro_completo")),
        Rule("V-07", fixed.WARN, "email + Fecha envio", c("rn") > 1,
             F.concat(c("email"), F.lit(" | "), text("fecha_envio_txt"))),
        Rule("V-08", fixed.WARN, "Fecha open", kept & (c("fecha_open") < c("fecha_envio")),
             F.concat(F.lit("envio="), text("fecha_envio_txt"), F.lit(" open="), text("fecha_open_txt"))),
        Rule("V-10", fixed.WARN, "Opens / Clicks", kept & (c("clicks") > 0) & c("fecha_open").isNull(),
             F.concat(F.lit("opens="), c("opens"), F.lit(" clicks="), c("clicks"))),
    ]


def record_incidents(ranked: DataFrame, lineage: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    return apply_rules(ranked, v_rules(), [*lineage, "registro_completo"])


def rejections(work: DataFrame, lineage: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    """The incidents that keep a record out. No rank decides them, so ``work`` need not be ranked."""
    return apply_rules(work, [r for r in v_rules() if r.severity == fixed.REJECT], [*lineage, "registro_completo"])


def file_incidents(ranked: DataFrame, by: Sequence[str] = ("file_id",)) -> DataFrame:
    """V-09: columns that arrived empty in every record of a file."""
    return empty_columns(ranked, fixed.EMPTY_CHECKED, by).select(
        *by, F.lit("V-09").alias("codigo_error"), F.lit(fixed.WARN).alias("severidad"), "campo")


def incidents(ranked: DataFrame, lineage: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    """Everything load-time validation has to say, at record and at file level."""
    by = [c for c in lineage if c != "line_no"]
    return record_incidents(ranked, lineage).unionByName(file_incidents(ranked, by), allowMissingColumns=True)


# --- business-rule matrix -----------------------------------------------------------------
ERROR, WARNING, VALID, UNKNOWN = "ERROR", "WARNING", "VALID", "UNKNOWN"


def _facts() -> dict[str, Column]:
    """Named conditions the matrix is written in."""
    c = F.col
    f = {
        "opens": c("opens") > 0, "clicks": c("clicks") > 0,
        "open_date": c("fecha_open").isNotNull(), "click_date": c("fecha_click").isNotNull(),
        "links": c("links").isNotNull(), "ip": c("ips").isNotNull(),
        "browser": c("navegadores").isNotNull(), "platform": c("plataformas").isNotNull(),
        "badmail": c("badmail").isNotNull(), "baja": F.coalesce(F.upper("baja") == "SI", F.lit(False)),
        "email": blank_to_null("email").isNotNull(),
    }
    f["engaged"] = f["opens"] | f["clicks"]
    f["opened"] = f["opens"] | f["open_date"]
    f["no_metadata"] = ~(f["ip"] | f["browser"] | f["platform"])
    return f


def br_rules() -> list[Rule]:
    """Record-level rules of the matrix."""
    c, f = F.col, _facts()
    def text_present(name: str) -> Column:
        return blank_to_null(name).isNotNull()
    def malformed(name: str) -> Column:
        return text_present(f"{name}_txt") & ~F.trim(f"{name}_txt").rlike(fixed.DIGITS)
    send, opened, click = c("fecha_envio"), c("fecha_open"), c("fecha_click")
    spec = [
        ("BR-001", ERROR, "Fecha open", f["opens"] & ~f["open_date"]),
        ("BR-002", WARNING, "Fecha open", ~f["opens"] & f["open_date"]),
        ("BR-003", ERROR, "Fecha click", f["clicks"] & ~f["click_date"]),
        ("BR-004", WARNING, "Fecha click", ~f["clicks"] & f["click_date"]),
        ("BR-005", WARNING, "Clicks", f["clicks"] & ~f["opens"]),
        ("BR-006", WARNING, "Fecha click", click < opened),
        ("BR-007", WARNING, "Links", f["links"] & ~f["clicks"]),
        ("BR-008", WARNING, "Links", f["clicks"] & ~f["links"]),
        ("BR-009", WARNING, "Opens virales", c("opens_virales") > c("opens")),
        ("BR-010", WARNING, "Clicks virales", c("clicks_virales") > c("clicks")),
        ("BR-011", WARNING, "Badmail", f["badmail"] & f["engaged"]),
        ("BR-012", VALID, "Baja", f["baja"] & f["engaged"]),
        ("BR-013", VALID, "Baja", f["baja"] & f["clicks"]),
        ("BR-014", VALID, "Baja", f["baja"] & f["opens"]),
        ("BR-015", UNKNOWN, "Baja", f["baja"] & f["click_date"]),
        ("BR-016", UNKNOWN, "Baja", f["baja"] & f["open_date"]),
        ("BR-017", WARNING, "IPs", f["ip"] & ~f["opened"]),
        ("BR-018", WARNING, "Navegadores", f["browser"] & ~f["opened"]),
        ("BR-019", WARNING, "Plataformas", f["platform"] & ~f["opened"]),
        ("BR-020", WARNING, "IPs", f["no_metadata"] & f["engaged"]),
        ("BR-021", WARNING, "IPs", f["opens"] & ~f["ip"]),
        ("BR-022", WARNING, "IPs", f["clicks"] & ~f["ip"]),
        ("BR-024", WARNING, "Fecha open", opened < send),
        ("BR-025", WARNING, "Fecha click", click < send),
        ("BR-026", WARNING, "Fecha click", click < opened),
        ("BR-027", VALID, "Fecha open", opened == send),
        ("BR-028", VALID, "Fecha click", click == opened),
        ("BR-040", ERROR, "email", ~f["email"]),
        ("BR-041", ERROR, "email", f["email"] & ~c("email_ok")),
        ("BR-042", ERROR, "Opens / Clicks", malformed("opens") | malformed("clicks")),
    ]
    for code in ("BR-023", "BR-043"):
        spec += [(code, ERROR, d, text_present(f"{d}_txt") & c(d).isNull())
                 for d in ("fecha_envio", "fecha_open", "fecha_click")]
    evidence = c("registro_completo")
    return [Rule(code, sev, field, cond, evidence) for code, sev, field, cond in spec]


INTERACTION = ("opens", "opens_virales", "fecha_open", "clicks", "clicks_virales", "fecha_click")


def with_repetition(work: DataFrame, file: str = "file_id") -> DataFrame:
    """Add how often the email, the send and the whole record occur, in how many
    files, and whether their interaction data differ. Each is an aggregate joined
    back; minimum against maximum tells "more than one" without a distinct."""
    action = F.struct(*INTERACTION)
    def spans(col, name):
        return (F.min(col) != F.max(col)).alias(name)
    named = work.filter(blank_to_null("email").isNotNull())
    per_email = named.groupBy("email").agg(
        F.count(F.lit(1)).alias("_email_n"), spans(file, "_email_files"), spans("fecha_envio", "_email_sends"),
        spans(action, "_email_differs"))
    per_send = named.filter("fecha_envio IS NOT NULL").groupBy("email", "fecha_envio").agg(
        F.count(F.lit(1)).alias("_send_n"), spans(file, "_send_files"), spans(action, "_send_differs"))
    key = F.sha2("registro_completo", 256)
    per_record = work.groupBy(key.alias("_sha")).agg(F.count(F.lit(1)).alias("_same_n"))
    # written, so that each join shuffles both sides itself: adaptive execution then splits a busy (or missing) address
    per_email, per_send, per_record = (write_once(d, n) for d, n in ((per_email, "per-email"), (per_send, "per-send"), (per_record, "per-record")))
    return (
        work.withColumn("_sha", key)
        .join(per_email, "email", "left").join(per_send, ["email", "fecha_envio"], "left").join(per_record, "_sha", "left")
    )


def br_repetition_rules() -> list[Rule]:
    """Rules on repeated records, over the columns of ``with_repetition``."""
    c = F.col
    many_sends, many_same = c("_send_n") > 1, c("_same_n") > 1
    spec = [
        ("BR-029", WARNING, c("_email_n") > 1), ("BR-030", WARNING, many_sends), ("BR-031", WARNING, many_same),
        ("BR-032", WARNING, (c("_email_n") > 1) & c("_email_differs")),
        ("BR-033", WARNING, c("_email_files")), ("BR-034", WARNING, c("_send_files")),
        ("BR-035", VALID, c("_email_files") & c("_email_sends")),
        ("BR-036", WARNING, c("_send_files") & c("_send_differs")),
        ("BR-044", WARNING, many_same), ("BR-045", WARNING, many_sends),
    ]
    return [Rule(code, sev, "email", cond, c("email")) for code, sev, cond in spec]


def br_findings(work: DataFrame, lineage: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    return apply_rules(with_repetition(work), br_rules() + br_repetition_rules(), lineage)


# --- scenario labels ------------------------------------------------------------------------
def scenario_conditions() -> dict[str, Column]:
    """Descriptive labels of one record, by name."""
    c, f = F.col, _facts()
    op, cl, od, cd = f["opens"], f["clicks"], f["open_date"], f["click_date"]
    out: dict[str, Column] = {}

    def grid(none, both, count_only, date_only, count, date):
        out.update({none: ~count & ~date, both: count & date, count_only: count & ~date, date_only: ~count & date})

    def ordering(a, b, before, at, after):
        out.update({before: a < b, at: a == b, after: a > b})

    grid("OPEN_NONE", "OPEN_COUNT_AND_DATE", "OPEN_COUNT_WITHOUT_DATE", "OPEN_DATE_WITH_ZERO_COUNT", op, od)
    grid("CLICK_NONE", "CLICK_COUNT_AND_DATE", "CLICK_COUNT_WITHOUT_DATE", "CLICK_DATE_WITH_ZERO_COUNT", cl, cd)
    out.update({
        "CLICK_WITHOUT_OPEN_COUNT": cl & ~op, "CLICK_WITH_OPEN_COUNT": cl & op, "OPEN_WITHOUT_CLICK": op & ~cl,
        "LINKS_WITH_CLICKS": f["links"] & cl, "LINKS_WITHOUT_CLICKS": f["links"] & ~cl,
        "CLICK_WITHOUT_LINKS": cl & ~f["links"],
    })
    for kind, flag in (("OPENS", op), ("CLICKS", cl)):
        viral, total = c(f"{kind.lower()}_virales"), c(kind.lower())
        ordering(viral, total, f"VIRAL_{kind}_LESS_THAN_{kind}", f"VIRAL_{kind}_EQUAL_{kind}",
                 f"VIRAL_{kind}_GREATER_THAN_{kind}")
        out[f"VIRAL_{kind}_EQUAL_{kind}"] &= flag  # 0 = 0 says nothing
    for name, flag in (("BAJA", f["baja"]), ("BADMAIL", f["badmail"])):
        out.update({f"{name}_WITHOUT_ENGAGEMENT": flag & ~f["engaged"], f"{name}_WITH_ENGAGEMENT": flag & f["engaged"],
                    f"NO_{name}_WITH_ENGAGEMENT": ~flag & f["engaged"]})
    out.update({"BAJA_WITH_CLICK": f["baja"] & cl, "BAJA_WITH_OPEN": f["baja"] & op})
    ip, br, pl = f["ip"], f["browser"], f["platform"]
    out.update({
        "METADATA_PRESENT": ~f["no_metadata"], "METADATA_ABSENT": f["no_metadata"],
        "ALL_METADATA_ABSENT": f["no_metadata"], "IP_PRESENT": ip, "BROWSER_PRESENT": br, "PLATFORM_PRESENT": pl,
        "FULL_METADATA": ip & br & pl, "IP_ONLY": ip & ~br & ~pl, "BROWSER_ONLY": ~ip & br & ~pl,
        "PLATFORM_ONLY": ~ip & ~br & pl, "IP_BROWSER_ONLY": ip & br & ~pl, "IP_PLATFORM_ONLY": ip & ~br & pl,
        "BROWSER_PLATFORM_ONLY": ~ip & br & pl,
    })
    send, opened, click = c("fecha_envio"), c("fecha_open"), c("fecha_click")
    ordering(opened, send, "OPEN_BEFORE_SEND", "OPEN_AT_SEND_TIME", "OPEN_AFTER_SEND")
    ordering(click, send, "CLICK_BEFORE_SEND", "CLICK_AT_SEND_TIME", "CLICK_AFTER_SEND")
    ordering(click, opened, "CLICK_BEFORE_OPEN", "CLICK_AT_OPEN_TIME", "CLICK_AFTER_OPEN")
    out.update({
        "CLICK_WITHOUT_ANY_OPEN_SIGNAL": cl & ~op & ~od, "OPEN_AND_CLICK": op & cl, "OPEN_ONLY": op & ~cl,
        "NO_RECORDED_ENGAGEMENT": ~op & ~cl, "COMPLETELY_INACTIVE": ~op & ~cl & ~od & ~cd,
        "COMPLETE_OPEN_CLICK_EVENT_DATA": op & cl & od & cd, "OPEN_EVENT_WITHOUT_CLICK": op & ~cl & od,
        "CLICK_EVENT_PRESENT": cl & cd,
    })
    return out


def scenario_labels(work: DataFrame, carry: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    """One row per record and label that describes it."""
    marks = [F.when(cond, F.lit(name)) for name, cond in scenario_conditions().items()]
    return work.select(*carry, F.explode(F.array(*marks)).alias("label")).filter("label IS NOT NULL")


def scenario_counts(work: DataFrame, by: Sequence[str] = ("file_id",)) -> DataFrame:
    """Records per file and label. Labels are counted as columns first, so a
    record is never multiplied by its labels."""
    conds = scenario_conditions()
    wide = work.groupBy(*by).agg(*[F.count_if(cond).alias(name) for name, cond in conds.items()])
    return wide.unpivot(list(by), list(conds), "label", "records").filter("records > 0")


def scenario_matrix(counts: DataFrame, file: str, files: Sequence) -> DataFrame:
    """Labels against the named files, zero where a label does not occur."""
    wide = counts.groupBy("label").pivot(file, list(files)).agg(F.sum("records"))
    return wide.select("label", *[F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(f"file_{f}") for f in files])
