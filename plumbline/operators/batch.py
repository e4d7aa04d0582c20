"""One batch load, from the files of an inbox to the targets, visible as a whole or not at all.

A load writes its rows to a folder of its own and then appends one row to the log. That row, one small file put in place by one rename, is the commit: readers look only into folders the log names. A load
that fails, or whose control points fail, leaves its run in the log and nothing in the targets; one that is killed leaves an open run, and the next load takes
the same files again. ``compact`` folds what is committed into a snapshot, which is committed the same way.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from ..functions import fixed
from ..session import write_once
from ..sources import files as fs, records
from . import etl, monitor, rules
from .windows import surrogate_key

KEYED = {"statistics": (["email", "fecha_envio"], etl.STATISTICS_POLICY), "visits": (["email", "fecha_visita"], etl.VISIT_POLICY)}
TABLES = (*KEYED, "incidents", "files")
SEQ = ("id_ejecucion", "file_id", "line_no")
COUNTS = ("archivos_detectados", "archivos_cargados", "archivos_omitidos", "archivos_rechazados", "registros_leidos", "registros_cargados", "registros_error", "registros_advertencia")
LOG = ("version bigint, kind string, attempt string, id_ejecucion bigint, estatus string, fecha_inicio timestamp, fecha_fin timestamp, duracion_segundos bigint, "
       + ", ".join(f"{c} bigint" for c in COUNTS) + ", mensaje string")
FILES = "id_ejecucion bigint, file_id bigint, nombre_archivo string, hash_archivo string, bytes bigint, estatus string, registros_leidos bigint, motivo_rechazo string"
#: A run that is open longer than this is taken for dead.
HUNG_HOURS = 6
INCIDENTS = ("id_ejecucion", "file_id", "nombre_archivo", "line_no", "codigo_error", "severidad", "campo", "valor_original", "registro_completo")


class Busy(RuntimeError):
    """Another load is running."""


class Store:
    """The targets under a folder, as its log has them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def create(self) -> Store:
        """Starts an empty log."""
        self._append(version=0, kind="start", attempt="", fecha_inicio=_now())
        return self

    def log(self) -> DataFrame:
        """Rows of the log. Of two commits of one version, the one with the smaller attempt counts, for every reader."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        wins = rows.where("version IS NOT NULL").groupBy("version").agg(F.min("attempt").alias("_wins"))
        return rows.join(wins, "version", "left").where("version IS NULL OR attempt = _wins").select(*rows.columns)

    def _rows(self) -> list[Row]:
        """``log`` on the driver: a row or two per load since ever."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.root}/log").collect()
        wins: dict[int, str] = {}
        for r in rows:
            if r.version is not None:
                wins[r.version] = min(r.attempt, wins.get(r.version, r.attempt))
        return [r for r in rows if r.version is None or r.attempt == wins[r.version]]

    def runs(self) -> DataFrame:
        """A row per run, as far as it got."""
        done = F.max_by(F.struct(*[F.col(c) for c in self.log().columns if c not in ("id_ejecucion", "kind", "version")]), F.coalesce("version", F.lit(-1)))
        return self.log().where("id_ejecucion IS NOT NULL").groupBy("id_ejecucion").agg(done.alias("r")).select("id_ejecucion", "r.*")

    def _append(self, **row) -> None:
        names = [c.split()[0] for c in LOG.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _next(self) -> tuple[int, int]:
        rows = self._rows()
        return max(r.version or 0 for r in rows) + 1, max(r.id_ejecucion or 0 for r in rows) + 1

    def commit(self, attempt: str, **row) -> int:
        """Appends a versioned row; an error if another writer was first."""
        version = self._next()[0]
        self._append(version=version, attempt=attempt, **row)
        if not any(r.version == version and r.attempt == attempt for r in self._rows()):
            raise Busy(f"version {version} was committed by another load")
        return version

    def parts(self, also: str | None = None) -> list[str]:
        """Folders that are visible: the last snapshot and the good loads after it. As many as there were loads since then."""
        good = sorted((r.version, r.kind, r.attempt) for r in self._rows() if r.kind in ("load", "snapshot") and r.estatus in (fixed.RUN_OK, fixed.RUN_WARN))
        last = max((v for v, kind, _ in good if kind == "snapshot"), default=0)
        return [a for v, _, a in good if v >= last] + ([also] if also else [])

    def table(self, name: str, also: str | None = None) -> DataFrame:
        """Committed rows of a table (and those of the attempt ``also``): the fold of the parts for keyed tables, else their union."""
        paths = [f"{self.root}/data/{a}/{name}" for a in self.parts(also)]
        if not paths:
            return self.spark.createDataFrame([], FILES) if name == "files" else self.spark.createDataFrame([], EMPTY[name])
        rows = self.spark.read.parquet(*paths)
        return etl.upsert(None, rows, *KEYED[name], SEQ) if name in KEYED else rows

    def visitors(self, as_of: str, also: str | None = None) -> DataFrame:
        return etl.build_visitors(self.table("visits", also), as_of)

    def compact(self) -> int:
        """Folds everything visible into one snapshot. Readers see the old parts or the snapshot, never both."""
        attempt = uuid.uuid4().hex
        for name in TABLES:
            _write(self.table(name), f"{self.root}/data/{attempt}/{name}")
        return self.commit(attempt, kind="snapshot", estatus=fixed.RUN_OK, fecha_inicio=_now(), fecha_fin=_now())


_AT = "struct<s0: bigint, s1: bigint, s2: bigint>"
EMPTY = {
    "statistics": "email string, fecha_envio timestamp_ntz, opens bigint, opens_virales bigint, clicks bigint, clicks_virales bigint, fecha_open timestamp_ntz, fecha_click timestamp_ntz, links string, ips string, "
                  f"navegadores string, plataformas string, jyv string, badmail string, baja string, file_id bigint, _first {_AT}, _last {_AT}",
    "visits": f"email string, fecha_visita timestamp_ntz, clicks bigint, file_id bigint, _first {_AT}, _last {_AT}",
    "incidents": "id_ejecucion bigint, file_id bigint, nombre_archivo string, line_no bigint, codigo_error string, severidad string, campo string, valor_original string, registro_completo string",
}


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _named(found: DataFrame, listed: DataFrame, run: int) -> DataFrame:
    """Incidents with the name of their file and all columns of INCIDENTS."""
    kinds = dict(x.split() for x in EMPTY["incidents"].split(", "))
    both = found.join(listed.select("file_id", F.col("file").alias("nombre_archivo")), "file_id").withColumn("id_ejecucion", F.lit(run).cast("long"))
    return both.select(*[(F.col(c) if c in both.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in INCIDENTS])


def file_level(judged: DataFrame, mismatches: DataFrame, off: DataFrame) -> DataFrame:
    """What the load (V-01, V-02) and the matrix (BR-037 to BR-039) have to say about whole files: (file, line_no, codigo_error, severidad, campo, valor_original)."""
    def said(df: DataFrame, code: str, severity: str, field: Column | str, value: Column, line: int | None = None) -> DataFrame:
        return df.select("file", F.lit(line).cast("long").alias("line_no"), F.lit(code).alias("codigo_error"), F.lit(severity).alias("severidad"),
                         (F.lit(field) if isinstance(field, str) else field).alias("campo"), value.alias("valor_original"))
    why = F.col("reason")
    bad = judged.where("reason IS NOT NULL")
    width = F.concat_ws(" ", F.lit("columns:"), F.col("header_width"), F.col("min_width"), F.col("max_width"))
    headers = mismatches.select("file").union(bad.where(why == "anchor headers").select("file")).distinct()
    out = [said(bad, "V-01", fixed.REJECT, "layout", why),
           said(off, "V-01", fixed.REJECT, "carga", F.concat(F.lit("expected "), F.col("rows"), F.lit(", loaded "), F.col("loaded"))),
           said(mismatches, "V-02", fixed.WARN, F.col("expected"), F.col("found"), 1),
           said(bad.where(why.isin("header column count", "row column count")), "BR-037", rules.ERROR, "layout", width),
           said(headers, "BR-038", rules.ERROR, "layout", F.lit("header missing or incorrect"), 1),
           said(bad.where(why == "empty file"), "BR-039", rules.ERROR, "layout", F.lit("empty file"))]
    found = out[0]
    for o in out[1:]:
        found = found.union(o)
    return found


def load(store: Store, folder: str | Sequence[str], as_of: str, pattern: str = fixed.REPORT_NAME, quiet: int = fixed.QUIET_MINUTES, full_path: bool = False) -> int:
    """Loads what is new in ``folder`` and quiet at ``as_of``, and returns the number of the run; its row is in ``store.runs()``.

    Files whose content was loaded before, under any name, are left out. A file with a bad layout is rejected as a whole, with an incident, and so is one that does not load completely. Rows are counted
    while they are written. If a control point fails, the run is FALLIDO and nothing of it is visible; an error does the same and is raised.
    """
    def listing() -> tuple[DataFrame, DataFrame]:
        manifest = fs.quiet_files(fs.file_manifest(store.spark, folder, pattern, full_path), as_of, quiet)
        return fs.with_hash(store.spark, manifest, folder), store.spark.read.text(folder)

    return _run(store, listing, as_of, full_path, uuid.uuid4().hex)


def load_text(store: Store, text: DataFrame, as_of: str, attempt: str) -> int | None:
    """Loads the files of a text that was read with file metadata, such as a micro-batch. ``attempt`` names the load: one that is committed is not loaded
    again, and what is left of a broken one is overwritten."""
    for r in store._rows():
        if r.attempt == attempt and r.kind == "load" and r.estatus != fixed.RUN_FAILED:
            return r.id_ejecucion

    def listing() -> tuple[DataFrame, DataFrame]:
        lines = write_once(fs.number_lines(text, full_path=True), "lines")
        files = write_once(text.select(fs.one_spelling("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct().withColumn("path", F.col("file")), "batch-files")
        return fs.identity(files, lines), text

    return _run(store, listing, as_of, True, attempt)


def _run(store: Store, listing: Callable[[], tuple[DataFrame, DataFrame]], as_of: str, full_path: bool, attempt: str) -> int:
    began = _now()
    rows = store._rows()
    closed = {r.id_ejecucion for r in rows if r.kind == "load"}
    for r in rows:
        if r.kind == "open" and r.id_ejecucion not in closed and r.attempt != attempt and began.timestamp() - r.fecha_inicio.timestamp() < HUNG_HOURS * 3600:
            raise Busy(f"run {r.id_ejecucion} is open since {r.fecha_inicio}")
    run = store._next()[1]
    store._append(kind="open", attempt=attempt, id_ejecucion=run, estatus=fixed.RUN_OPEN, fecha_inicio=began)
    row: dict = dict.fromkeys(COUNTS, 0)

    def close(status: str, message: str | None) -> None:
        end = _now()
        store.commit(attempt, kind="load", id_ejecucion=run, estatus=status, fecha_inicio=began, fecha_fin=end, duracion_segundos=int((end - began).total_seconds()), mensaje=message, **row)

    try:
        failed = _load(store, *listing(), as_of, full_path, run, attempt, row)
    except Exception as error:
        close(fixed.RUN_FAILED, str(error)[:500])
        raise
    close(fixed.RUN_FAILED if failed else fixed.RUN_WARN if row["archivos_rechazados"] else fixed.RUN_OK, " | ".join(failed)[:500] or None)
    return run


def _load(store: Store, hashed: DataFrame, text: DataFrame, as_of: str, full_path: bool, run: int, attempt: str, row: dict) -> list[str]:
    spark, out = store.spark, f"{store.root}/data/{attempt}"
    hashed = write_once(hashed, "identity")
    known = store.table("files")
    fresh = fs.new_files(hashed, known.select(F.col("hash_archivo").alias("hash")))
    before = known.agg(F.max("file_id")).first()[0] or 0
    listed = write_once(surrogate_key(fresh.select("file", "path", "bytes", "hash"), ["file", "path"], "_n").select((F.col("_n") + before).alias("file_id"), "file", "path", "bytes", "hash"), "listed")
    row["archivos_detectados"], n = hashed.count(), listed.count()
    row["archivos_omitidos"] = row["archivos_detectados"] - n

    lines = write_once(records.read_records(text, full_path).join(listed.select("file"), "file", "left_semi"), "records")
    good, bad = fs.validate_layout(listed, lines)
    judged = write_once(good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad), "judged")
    good = judged.where("reason IS NULL")
    staged, off = fs.reconcile_load(fs.load_raw(lines, good), good)
    off = write_once(off, "not-loaded")
    raw = staged.join(listed.select("file", "file_id"), "file").withColumn("id_ejecucion", F.lit(run).cast("long"))
    counted, work = Observation(), Observation()
    raw = raw.observe(counted, F.count(F.lit(1)).alias("n"))
    cr = F.count_if(F.col("plataformas").endswith("\r")) + F.count_if(F.col("navegadores").endswith("\r"))
    typed = write_once(etl.type_records(raw, SEQ), "typed")  # read more than once by the ranking
    ranked = write_once(etl.rank_sends(typed).observe(work, F.count(F.lit(1)).alias("n"), F.count_if(F.col("rn") == 1).alias("kept"), F.count_if(F.col("rn") > 1).alias("discarded"), cr.alias("cr")), "ranked")

    said = Observation()
    by_file = file_level(judged, fs.header_mismatches(lines.join(good, "file", "left_semi")), off).join(listed.select("file", "file_id"), "file").drop("file")
    found = _named(rules.incidents(ranked, ("file_id", "line_no")).unionByName(by_file, allowMissingColumns=True), listed, run)
    found = found.observe(said, F.count_if(F.col("severidad") == fixed.REJECT).alias("rejects"), F.count_if(F.col("severidad") == fixed.WARN).alias("warnings"), F.count_if(F.col("codigo_error") == "V-07").alias("discards"))
    _write(etl.statistics(ranked, seq=SEQ), f"{out}/statistics")
    _write(etl.visits(ranked, seq=SEQ), f"{out}/visits")
    _write(found, f"{out}/incidents")
    state = listed.join(judged, "file").join(off.select("file", F.lit("load mismatch").alias("_off")), "file", "left").withColumn("motivo_rechazo", F.coalesce("reason", "_off"))
    rejected = F.col("motivo_rechazo").isNotNull()
    files, loaded = state.select(F.lit(run).cast("long").alias("id_ejecucion"), "file_id", F.col("file").alias("nombre_archivo"), F.col("hash").alias("hash_archivo"), "bytes",
                                 F.when(rejected, fixed.FILE_REJECTED).otherwise("CARGADO").alias("estatus"), F.when(rejected, 0).otherwise(F.col("rows")).cast("long").alias("registros_leidos"), "motivo_rechazo"), Observation()
    _write(files.observe(loaded, F.count_if(F.col("estatus") == "CARGADO").alias("n"), F.coalesce(F.sum("registros_leidos"), F.lit(0)).alias("rows")), f"{out}/files")

    row["archivos_cargados"], row["archivos_rechazados"] = loaded.get["n"], n - loaded.get["n"]
    row["registros_leidos"], row["registros_cargados"] = loaded.get["rows"], work.get["kept"]
    row["registros_error"], row["registros_advertencia"] = said.get["rejects"], said.get["warnings"]
    mine = spark.read.parquet(f"{out}/files").where("estatus = 'CARGADO'")
    per_file = mine.join(ranked.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")), "file_id", "left").where("coalesce(_n, 0) <> registros_leidos").count()
    checks = {"PC-5 staged = work": counted.get["n"] - work.get["n"], "PC-6 rows per file": per_file, "PC-7 discards audited": work.get["discarded"] - said.get["discards"], "PC-8 line ends": work.get["cr"]}
    visits = write_once(store.table("visits", attempt), "visits")
    target = monitor.target_integrity(store.table("statistics", attempt), visits, etl.build_visitors(visits, as_of[:10]))
    checks |= {f"PC-9 {r['check']}": r["value"] for r in target.collect()}
    return [f"{name}: {v}" for name, v in checks.items() if v]
