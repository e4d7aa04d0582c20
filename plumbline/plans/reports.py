"""Queries over report files, which are written from the campaign records first: one file as it should be, its twin, one
without the last column and one with a renamed header; all with CRLF line ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from ..functions import fixed
from ..operators import windows as w
from ..session import scratch
from ..sources import files
from .oracle import CTES, sql
from .registry import query

KINDS = ("plain", "twin", "narrow", "renamed")
_FIELDS = ("email", "jyv", "badmail", "baja", "fecha_envio", "fecha_open", "opens", "opens_virales", "fecha_click", "clicks", "clicks_virales", "links", "ips", "navegadores", "plataformas")


def _sql_record(cols) -> str:
    text = [f"regexp_replace(coalesce({c}, ''), '[\\r\\n]', '', 'g')" for c in cols]
    return " || ',' || ".join(f"CASE WHEN regexp_matches({t}, '[,\"]') THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END" for t in text)


CTES["report_lines"] = (("raw",), f"SELECT kind, file_id, line_no, CASE WHEN kind = 'narrow' THEN {_sql_record(_FIELDS[:-1])} ELSE {_sql_record(_FIELDS)} END AS line FROM raw, "
                        "(VALUES ('plain', 0), ('twin', 0), ('narrow', 1), ('renamed', 2)) k(kind, part) WHERE file_id % 3 = part")


def _reports(x) -> str:
    """The folder with a folder per kind."""
    root = scratch(x.spark, "reports")
    clean = {c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", "") for c in fixed.RAW_COLUMNS}
    rows = x.raw.select("file_id", "line_no", *[v.alias(c) for c, v in clean.items()])
    part = {"plain": 0, "twin": 0, "narrow": 1, "renamed": 2}
    heads = [h for _, h in fixed.LAYOUT]
    out = None
    for kind, p in part.items():
        keep = fixed.RAW_COLUMNS[:-1] if kind == "narrow" else fixed.RAW_COLUMNS
        head = ",".join([*heads[:3], "Unknown", *heads[4:]] if kind == "renamed" else heads[:len(keep)])
        lines = rows.where(F.col("file_id") % 3 == p).select(F.lit(kind).alias("kind"), F.col("file_id").cast("long").alias("a"), F.col("line_no").cast("long").alias("b"), fx.rebuild_record(keep).alias("value"))
        lines = lines.unionByName(x.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(head).alias("value")))
        out = lines if out is None else out.unionByName(lines)
    ordered = out.repartition("kind").sortWithinPartitions("kind", "a", "b")
    ordered.select("kind", "value").write.partitionBy("kind").option("lineSep", "\r\n").text(root)
    return root


def _kind(path: str = "path"):
    return F.regexp_extract(path, "kind=([a-z]+)", 1)


def _manifest(x, root):
    return files.file_manifest(x.spark, f"{root}/kind=*", r"^part-.*\.txt$").withColumn("file", _kind())


def _lines(x, root):
    return files.read_lines(x.spark, f"{root}/kind=*", full_path=True).withColumn("file", _kind("file"))


_HEAD = "email,jyv,Badmail,Baja,Fecha envio,Fecha open,Opens,Opens virales,Fecha click,Clicks,Clicks virales,Links,IPs,Navegadores,Plataformas"
_HEADS = {"plain": _HEAD, "twin": _HEAD, "narrow": _HEAD.removesuffix(",Plataformas"), "renamed": _HEAD.replace(",Baja,", ",Unknown,")}


@query(sql("SELECT kind AS file, FALSE AS quiet_in_2000, CAST(sum(octet_length(encode(line)) + 2) AS BIGINT) AS bytes FROM (SELECT kind, line FROM report_lines UNION ALL "
           + " UNION ALL ".join(f"SELECT '{k}', '{h}'" for k, h in _HEADS.items()) + ") GROUP BY kind", "report_lines"))
def report_manifest(x):
    root = _reports(x)
    manifest = _manifest(x, root)
    quiet, early = (files.quiet_files(manifest, f"{year}-01-01 00:00:00") for year in (2999, 2000))
    return quiet.join(early.select("file", F.lit(True).alias("e")), "file", "left").select("file", "bytes", F.coalesce("e", F.lit(False)).alias("quiet_in_2000"))


@query(sql("SELECT count(*) AS files, count(DISTINCT d) AS new_files, CAST(0 AS BIGINT) AS again FROM (SELECT kind, md5(string_agg(line, chr(10) ORDER BY file_id, line_no)) AS d FROM report_lines GROUP BY kind)", "report_lines"))
def report_identity(x):
    """Files by content: the twin is not new, and nothing is new a second time."""
    root = _reports(x)
    hashed = files.with_hash(x.spark, _manifest(x, root), f"{root}/kind=*")
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c)).scalar()
    new = files.new_files(hashed, hashed.limit(0))
    return x.spark.range(1).select(n(hashed, "files").alias("files"), n(new, "new_files").alias("new_files"), n(files.new_files(hashed, new), "again").alias("again"))


@query(sql("SELECT kind AS file, count(*) AS rows, CASE kind WHEN 'narrow' THEN 'header column count' END AS reason FROM report_lines GROUP BY kind", "report_lines"))
def report_layout(x):
    root = _reports(x)
    good, bad = files.validate_layout(_manifest(x, root), _lines(x, root))
    return good.select("file", "rows", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("file", "rows", "reason"))


@query(sql("SELECT DISTINCT kind AS file, CAST(CASE kind WHEN 'narrow' THEN 14 ELSE 15 END AS INT) AS header_width, CASE kind WHEN 'renamed' THEN '4:Unknown' ELSE '' END AS differs FROM report_lines", "report_lines"))
def report_headers(x):
    root = _reports(x)
    lines = _lines(x, root)
    off = files.header_mismatches(lines).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat("position", F.lit(":"), "found"))), ",").alias("differs"))
    return files.layout_stats(_manifest(x, root), lines).join(off, "file", "left").select("file", F.col("header_width").cast("int").alias("header_width"), F.coalesce("differs", F.lit("")).alias("differs"))


@query(sql("SELECT kind AS file, count(*) AS loaded, CAST(count(DISTINCT nullif(trim(email), '')) AS BIGINT) AS emails, kind = 'twin' AS mismatch FROM (SELECT kind, r.* FROM raw r, (VALUES ('plain', 0), ('twin', 0), ('renamed', 2)) k(kind, part) WHERE file_id % 3 = part) GROUP BY kind", "raw"))
def report_load(x):
    """Accepted files are loaded; a file whose count is off (one is set off on purpose) is named."""
    root = _reports(x)
    lines = _lines(x, root)
    good, _ = files.validate_layout(_manifest(x, root), lines)
    raw = files.load_raw(lines, good)
    counts = good.select("file", (F.col("rows") + F.when(F.col("file") == "twin", 1).otherwise(0)).alias("rows"))
    kept, off = files.reconcile_load(raw, counts)
    per_file = raw.groupBy("file").agg(F.count(F.lit(1)).alias("loaded"), F.countDistinct("email").alias("emails"))
    named = off.select("file", F.lit(True).alias("m")).unionByName(kept.select("file", F.lit(False).alias("m")).distinct())
    return per_file.join(named, "file").select("file", "loaded", "emails", F.col("m").alias("mismatch"))


@query(sql("SELECT kind AS file, count(*) + 1 AS crlf, CAST(0 AS BIGINT) AS lf, CAST(0 AS BIGINT) AS cr, bool_or(contains(line, '\"')) AS quoted, bool_or(contains(line, '\"')) AS crlf_quote_risk, 'utf-8' AS encoding, ',' AS delimiter FROM report_lines GROUP BY kind", "report_lines"))
def report_shape(x):
    root = _reports(x)
    out = None
    for kind in KINDS:
        sep = files.guess_delimiter(x.spark, f"{root}/kind={kind}").limit(1).select("delimiter").scalar()
        one = files.line_endings(x.spark, f"{root}/kind={kind}").select(F.lit(kind).alias("file"), "crlf", "lf", "cr", "quoted", "crlf_quote_risk", "encoding", sep.alias("delimiter"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("SELECT line FROM report_lines WHERE kind = 'plain' ORDER BY file_id, line_no LIMIT 5", "report_lines"))
def report_first_rows(x):
    lines = _lines(x, _reports(x)).where("file = 'plain' AND line_no > 1")
    return w.first_rows(lines, 5).select("line")
