"""Queries over whole loads: records over several lines, and the batch load from an inbox to the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import functions as fx
from ..functions import fixed
from ..operators import batch
from ..session import scratch
from ..sources import files, records
from .oracle import _RULES, sql
from .registry import query


@query("SELECT doc_id, CAST(3 AS INT) AS fields, CAST(1 + len(t) - len(replace(t, chr(10), '')) AS BIGINT) AS lines, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest "
       "FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g') AS t FROM documents)")
def multi_line_records(x):
    """Whole documents, line breaks included, as a quoted field of a delimited file with CRLF line ends, written and read back."""
    root = scratch(x.spark, "multi-line")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    x.table("documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted, F.lit('a "plain" end')).alias("value")).write.option("lineSep", "\r\n").text(root)
    found = records.read_records(x.spark.read.text(root)).select("lines", files.field_count("line").cast("int").alias("fields"), files.split_fields("line").alias("f"))
    text = F.get("f", 1)
    return found.select(F.get("f", 0).cast("bigint").alias("doc_id"), "fields", F.col("lines").cast("bigint").alias("lines"), F.length(text).cast("bigint").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


#: Rows of one report file at most, by line number.
_CHUNK = 1_000_000
_KIND = "CASE file_id % 7 WHEN 3 THEN 'narrow' WHEN 5 THEN 'renamed' ELSE 'plain' END"
_PER_RUN = {
    "detected": "SELECT box, count(*) AS n FROM listed GROUP BY box", "skipped": "SELECT box, count(*) FILTER (WHERE twin) FROM listed GROUP BY box",
    "loaded": "SELECT box, count(*) FILTER (WHERE NOT twin AND kind <> 'narrow') FROM listed GROUP BY box", "rejected": "SELECT box, count(*) FILTER (WHERE NOT twin AND kind = 'narrow') FROM listed GROUP BY box",
    "read": "SELECT box, count(*) FROM ranked GROUP BY box", "kept": "SELECT box, count(*) FILTER (WHERE rn = 1) FROM ranked GROUP BY box",
    "rejects": "SELECT box, count(*) FILTER (WHERE severidad = 'RECHAZO') FROM said GROUP BY box", "warnings": "SELECT box, count(*) FILTER (WHERE severidad = 'ADVERTENCIA') FROM said GROUP BY box",
}
_BATCH = (
    f", b AS (SELECT *, file_id % 2 AS box, line_no // {_CHUNK} AS chunk, {_KIND} AS kind, line_no % 13 = 0 AND contains(coalesce(ips, ''), ', ') AS broken FROM work), "
    "p AS (SELECT * REPLACE (2 + coalesce(sum(1 + broken::INT) OVER (PARTITION BY file_id, chunk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no) FROM b), "
    "ranked AS MATERIALIZED (SELECT *, CASE WHEN email_ok AND fecha_envio IS NOT NULL THEN row_number() OVER (PARTITION BY box, email, fecha_envio, (email_ok AND fecha_envio IS NOT NULL) "
    "ORDER BY opens DESC, clicks DESC, line_no DESC, file_id DESC, chunk DESC) END AS rn FROM p WHERE kind <> 'narrow'), "
    "once AS (SELECT DISTINCT file_id, chunk, box, kind FROM p), "
    "listed AS (SELECT *, false AS twin FROM once UNION ALL SELECT file_id, chunk, 1, kind, true FROM once WHERE box = 0 AND file_id % 7 = 1), "
    "said AS (SELECT file_id % 2 AS box, codigo_error, severidad FROM (" + " UNION ALL ".join(_RULES) + ") UNION ALL "
    + " UNION ALL ".join(f"SELECT box, 'V-09', 'ADVERTENCIA' FROM ranked GROUP BY box, file_id, chunk HAVING count({c}) = 0" for c in fixed.EMPTY_CHECKED)
    + " UNION ALL SELECT box, v.c, v.s FROM once, (VALUES ('narrow', 'V-01', 'RECHAZO'), ('narrow', 'BR-037', 'ERROR'), ('renamed', 'V-02', 'ADVERTENCIA'), ('renamed', 'BR-038', 'ERROR')) v(k, c, s) WHERE kind = v.k) "
    + " UNION ALL ".join(f"SELECT 'run ' || (box + 1) || ' {name}' AS what, CAST(n AS BIGINT) AS n FROM ({body}) t(box, n)" for name, body in _PER_RUN.items())
    + " UNION ALL SELECT 'run ' || (box + 1) || ' ' || CASE WHEN bool_or(kind = 'narrow') THEN 'OK_CON_ADVERTENCIAS' ELSE 'OK' END, CAST(1 AS BIGINT) FROM once GROUP BY box"
    + " UNION ALL SELECT 'code ' || codigo_error, count(*) FROM said GROUP BY codigo_error"
    + " UNION ALL SELECT 'runs with a duration', CAST(2 AS BIGINT)"
    + " UNION ALL SELECT w, CAST(v AS BIGINT) FROM (SELECT count(*) AS a, sum(o) AS b, sum(c) AS c FROM (SELECT max(opens) AS o, max(clicks) AS c FROM ranked WHERE rn = 1 GROUP BY email, fecha_envio)) s, "
      "LATERAL (VALUES ('statistics', a), ('opens', b), ('clicks', c)) t(w, v)"
    + " UNION ALL SELECT w, CAST(v AS BIGINT) FROM (SELECT count(*) AS a, sum(c) AS b FROM (SELECT max(clicks) AS c FROM ranked WHERE rn IS NOT NULL AND clicks > 0 AND fecha_click IS NOT NULL GROUP BY email, fecha_click)) s, "
      "LATERAL (VALUES ('visits', a), ('clicks of visits', b)) t(w, v)")


def _lines(x) -> DataFrame:
    """(box, file, line_no, value): the lines of ``_inbox``. A line of a file that has a copy is made once."""
    fid, line = F.col("file_id"), F.col("line_no")
    clean = {c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", "") for c in fixed.RAW_COLUMNS}
    rows = x.raw.select("file_id", "line_no", *[v.alias(c) for c, v in clean.items()])
    rows = rows.withColumn("ips", F.when(line % 13 == 0, F.replace("ips", F.lit(", "), F.lit(",\n"))).otherwise(F.col("ips"))).withColumn("chunk", F.floor(line / _CHUNK))
    # a record with a line break is quoted because of its comma
    whole, short = fx.rebuild_record(fixed.RAW_COLUMNS), fx.rebuild_record(fixed.RAW_COLUMNS[:-1])
    lines = rows.select("file_id", "chunk", "line_no", F.when(fid % 7 == 3, short).otherwise(whole).alias("value"))
    heads = [h for _, h in fixed.LAYOUT]
    head = F.when(fid % 7 == 3, ",".join(heads[:-1])).when(fid % 7 == 5, ",".join([*heads[:3], "Unknown", *heads[4:]])).otherwise(",".join(heads))
    lines = lines.unionByName(rows.select("file_id", "chunk").distinct().select("file_id", "chunk", F.lit(-1).cast("long").alias("line_no"), head.alias("value")))
    place = lambda box, kind: F.struct(box.cast("long").alias("box"), F.format_string(f"{kind}%014d-%08d", "file_id", "chunk").alias("file"))
    first = place(fid % 2, "a")
    places = F.when((fid % 2 == 0) & (fid % 7 == 1), F.array(first, place(F.lit(1), "b"))).otherwise(F.array(first))
    return lines.select(F.explode(places).alias("_p"), "line_no", "value").select("_p.box", "_p.file", "line_no", "value")


def _inbox(x) -> str:
    """All campaign records as report files in two folders: every seventh file without its last column, every seventh with a renamed one, some records over two lines; the second
    folder has copies of some files of the first, too."""
    root = scratch(x.spark, "inbox")
    dealt = _lines(x).repartition("box", "file").sortWithinPartitions("box", "file", "line_no")
    dealt.select("box", "file", "value").write.partitionBy("box", "file").option("lineSep", "\r\n").text(root)
    return root


@query(sql(_BATCH, "work"))
def batch_load(x):
    """Two loads one after the other, from files to committed targets: run rows, incidents by code, totals."""
    root = _inbox(x)
    store = batch.Store(x.spark, scratch(x.spark, "store")).create()
    for box in (0, 1):
        batch.load(store, f"{root}/box={box}/*", "2999-01-01 00:00:00", pattern=r"^part-.*\.txt$", full_path=True)
    runs = store.runs()
    names = dict(zip(("detected", "skipped", "loaded", "rejected", "read", "kept", "rejects", "warnings"),
                     ("archivos_detectados", "archivos_omitidos", "archivos_cargados", "archivos_rechazados", "registros_leidos", "registros_cargados", "registros_error", "registros_advertencia")))
    pair = lambda label, n: F.struct(label.alias("what"), n.cast("long").alias("n"))
    run = F.concat(F.lit("run "), F.col("id_ejecucion"), F.lit(" "))
    per_run = [pair(F.concat(run, F.lit(k)), F.col(c)) for k, c in names.items()] + [pair(F.concat(run, F.col("estatus")), F.lit(1))]
    out = runs.select(F.explode(F.array(*per_run)).alias("p")).select("p.*")
    codes = store.table("incidents").groupBy(F.concat(F.lit("code "), F.col("codigo_error")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    known = runs.agg(F.count_if(F.col("duracion_segundos") >= 0).alias("n")).select(F.lit("runs with a duration").alias("what"), "n")
    stats = store.table("statistics").agg(F.count(F.lit(1)).alias("a"), F.sum("opens").alias("b"), F.sum("clicks").alias("c"))
    stats = stats.select(F.explode(F.array(*[pair(F.lit(w), F.col(c)) for w, c in (("statistics", "a"), ("opens", "b"), ("clicks", "c"))])).alias("p")).select("p.*")
    visits = store.table("visits").agg(F.count(F.lit(1)).alias("a"), F.sum("clicks").alias("b"))
    visits = visits.select(F.explode(F.array(*[pair(F.lit(w), F.col(c)) for w, c in (("visits", "a"), ("clicks of visits", "b"))])).alias("p")).select("p.*")
    for more in (codes, known, stats, visits):
        out = out.union(more)
    return out
