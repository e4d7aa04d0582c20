"""Campaign records: typed layer, ranking, targets built by upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blank_to_null, email_ok, fixed, guarded_int, is_count, parse_any, rebuild_record
from .windows import rank_best

COUNTERS = ("opens", "opens_virales", "clicks", "clicks_virales")
DATES = ("fecha_envio", "fecha_open", "fecha_click")
TEXTS = ("jyv", "badmail", "baja", "links", "ips", "navegadores", "plataformas")


def stage(raw: DataFrame) -> DataFrame:
    """All-text staging: trimmed, no trailing carriage return, empty becomes
    NULL. The dash stays: it is evidence of how the source wrote "nothing"."""
    return raw.withColumns({c: F.nullif(F.trim(F.col(c), F.lit(" \r")), F.lit("")) for c in fixed.RAW_COLUMNS})


def type_records(raw: DataFrame, lineage: Sequence[str] = ("file_id", "line_no")) -> DataFrame:
    """Typed work layer. Nothing can fail: unreadable dates become NULL and
    unreadable counters 0, each with a flag or the original text beside it."""
    digits = [is_count(c) for c in ("opens", "clicks")]
    return raw.select(
        *lineage,
        F.lower(F.trim("email")).alias("email"),
        F.trim("email").alias("email_original"),
        *[blank_to_null(c).alias(c) for c in TEXTS],
        *[F.trim(c).alias(f"{c}_txt") for c in DATES],
        *[parse_any(blank_to_null(c)).alias(c) for c in DATES],
        *[guarded_int(c).alias(c) for c in COUNTERS],
        *[F.trim(c).alias(f"{c}_txt") for c in ("opens", "clicks")],
        (digits[0] & digits[1]).alias("numericos_ok"),
        email_ok("email").alias("email_ok"),
        rebuild_record(fixed.RAW_COLUMNS).alias("registro_completo"),
    )


def takes_part() -> Column:
    """Does a record take part in the ranking? Each send among those that do keeps one."""
    return F.col("email_ok") & F.col("fecha_envio").isNotNull()


def sends(work: DataFrame) -> DataFrame:
    """(email, fecha_envio) of every send that has a row in the target, once. The row a send keeps need not be known for
    that, so nothing is ranked."""
    return work.filter(takes_part()).select("email", "fecha_envio").distinct()


def rank_sends(work: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Rank rows of the same send: most opens, most clicks, last line. Only rows
    with a good address and a send date take part. File and then line make the
    order total; the counters and a coarse line number split hot sends."""
    down = [F.desc(c) for c in ("opens", "clicks", "line_no", "file_id")]
    coarse = [-F.col("opens"), -F.col("clicks"), -F.floor(F.col("line_no") / 1_000_000)]
    return rank_best(work, [*batch, "email", "fecha_envio"], down,
                     takes_part(), coarse,
                     spread=["file_id", "line_no"])


# --- upsert --------------------------------------------------------------------------
STATISTICS_POLICY = {
    **{c: "max" for c in COUNTERS},
    **{c: "last" for c in ("fecha_open", "fecha_click", "links", "ips", "navegadores", "plataformas")},
    **{c: "first" for c in ("jyv", "badmail", "baja", "file_id")},
}
VISIT_POLICY = {"clicks": "max", "file_id": "last"}


def upsert(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], policy: Mapping[str, str],
           seq: Sequence[str], keep_nulls: bool = True) -> DataFrame:
    """Merge ``batch`` into ``target``: per key and column take the max, the last
    or the first value by ``seq``. With ``keep_nulls`` a later NULL erases an
    earlier value; without it the last non-null value stays.

    It is one aggregate: keys are combined before the shuffle, so a key that
    makes up much of the batch does not gather in one task. The result keeps the
    first and last sequence (without ``keep_nulls`` also that of every kept value), so merging is associative
    and results can be merged again with later batches.
    """
    def marked(df: DataFrame) -> DataFrame:
        at = F.struct(*[F.col(c).cast("long").alias(f"s{i}") for i, c in enumerate(seq)])
        done = {"_first", "_last"} <= set(df.columns)
        own = [(F.col(s) if s in df.columns else F.when(F.col(c).isNotNull(), F.col("_last") if done else at)).alias(s) for c, s in known.items()]
        ends = ["_first", "_last"] if done else [at.alias("_first"), at.alias("_last")]
        return df.select(*keys, *policy, *ends, *own)

    last = [c for c, p in policy.items() if p == "last"]
    # a kept value is as old as the row it came from, not as the last row of its key
    known = {} if keep_nulls else {c: f"_at_{c}" for c in last}
    rows = marked(batch) if target is None else marked(target).unionByName(marked(batch))
    first = [c for c, p in policy.items() if p == "first"]
    aggs = [F.max(c).alias(c) for c, p in policy.items() if p == "max"]
    if last and keep_nulls:
        aggs.append(F.max_by(F.struct(*last), "_last").alias("_l"))
    elif last:
        aggs += [F.max_by(c, s).alias(c) for c, s in known.items()] + [F.max(s).alias(s) for s in known.values()]
    if first:
        aggs.append(F.min_by(F.struct(*first), "_first").alias("_f"))
    merged = rows.groupBy(*keys).agg(*aggs, F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    where = {**{c: f"_f.{c}" for c in first}, **({c: f"_l.{c}" for c in last} if keep_nulls else {})}
    return merged.select(*keys, *[F.col(where.get(c, c)).alias(c) for c in policy], "_first", "_last", *known.values())


def statistics(ranked: DataFrame, target: DataFrame | None = None, seq=("file_id", "line_no"), columns: Sequence[str] = tuple(STATISTICS_POLICY),
               **kw) -> DataFrame:
    """Send-level target, from the kept row of every send; with only some of its ``columns`` where a reader needs no more."""
    return upsert(target, ranked.filter("rn = 1"), ["email", "fecha_envio"], {c: STATISTICS_POLICY[c] for c in columns}, seq, **kw)


def visits(ranked: DataFrame, target: DataFrame | None = None, seq=("file_id", "line_no")) -> DataFrame:
    """Click-level target. Its grain is the click instant, so rows that lost the
    ranking of their send still count here; rows that are not ranked yet do as well."""
    part = F.col("rn").isNotNull() if "rn" in ranked.columns else takes_part()
    rows = ranked.filter(part).filter("clicks > 0 AND fecha_click IS NOT NULL").withColumn(
        "fecha_visita", F.col("fecha_click"))
    return upsert(target, rows, ["email", "fecha_visita"], VISIT_POLICY, seq)


def visitor_totals(visit_rows: DataFrame, as_of: str) -> DataFrame:
    """First and last visit and clicks ever, this year and this month, as of a date."""
    day, when = F.lit(as_of).cast("date"), F.col("fecha_visita")
    this_year = F.year(when) == F.year(day)
    this_month = this_year & (F.month(when) == F.month(day))
    def clicks(cond):
        return F.sum(F.when(cond, F.col("clicks")).otherwise(0))
    return visit_rows.groupBy("email").agg(
        F.to_date(F.min(when)).alias("fechaPrimeraVisita"), F.to_date(F.max(when)).alias("fechaUltimaVisita"),
        F.sum("clicks").alias("visitasTotales"), clicks(this_year).alias("visitasAnioActual"),
        clicks(this_month).alias("visitasMesActual"))


build_visitors = visitor_totals


def visitor_view(visitors: DataFrame) -> DataFrame:
    fmt = {c: F.date_format(c, "yyyyMMdd") for c in ("fechaPrimeraVisita", "fechaUltimaVisita")}
    return visitors.withColumns(fmt)
