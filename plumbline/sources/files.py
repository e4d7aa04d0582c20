"""Delimited report files: manifest, identity, layout checks, raw load, shape.

Lines are read as text, so a large file is split over many tasks and each line
keeps its physical number. ``read_lines`` takes every line for a record; ``records.read_records`` puts records
together whose quoted fields have line breaks. Both give the columns that all checks here read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed, outside_quotes
from ..operators import profile as prof
from ..operators.etl import stage
from ..session import write_once


# --- manifest -----------------------------------------------------------------------
def file_manifest(spark: SparkSession, folder: str, pattern: str = fixed.REPORT_NAME, full_path: bool = False) -> DataFrame:
    """Files whose name matches, with size and modification time; called by name, or by ``full_path`` where
    names repeat across folders. Contents are not read. The reader skips empty files, which must be seen to be rejected, so
    those are taken from its listing."""
    reader = spark.read.format("binaryFile").load(folder)
    files = reader.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    plain = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # one spelling for every path
    listed = {plain(p).toString() for p in reader.inputFiles()}
    empty = _empty_files(spark, listed - {r["path"] for r in files.select("path").collect()})
    name = F.element_at(F.split("path", "/"), -1)
    return files.unionByName(empty).filter(name.rlike(pattern)).select(
        (one_spelling("path") if full_path else name).alias("file"), "path", "bytes", "modified")


def one_spelling(path: str | Column) -> Column:
    """One spelling of local paths, which readers and file metadata write with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _empty_files(spark: SparkSession, paths: set[str]) -> DataFrame:
    conf, rows = spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in sorted(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        rows.append((p, 0, path.getFileSystem(conf).getFileStatus(path).getModificationTime()))
    df = spark.createDataFrame(rows, "path string, bytes long, ms long")
    return df.select("path", "bytes", F.timestamp_millis("ms").alias("modified"))


def quiet_files(manifest: DataFrame, as_of: str, minutes: int = fixed.QUIET_MINUTES) -> DataFrame:
    """Files nobody has written to for a while."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return manifest.filter(F.col("modified") <= limit)


#: A node of the tree of digests has so many children; the root has what is left after LEVELS levels.
FAN, LEVELS = 4096, 2


def content_tree(lines: DataFrame) -> DataFrame:
    """(file, root, lines) of numbered lines: a tree of SHA-256 digests of lines, of FAN digests each, and of those. Lines have the same numbers however a file is split, so the
    tree is the same; a node is one small group, so no file is one row or one task. 40 bytes a line are shuffled."""
    level = lines.select("file", F.col("line_no").alias("at"), F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("digest"))
    joined = F.sha2(F.unhex(F.array_join(F.transform("d", lambda x: F.hex(x["digest"])), "")), 256)
    nodes = F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("d")
    for _ in range(LEVELS):
        level = level.groupBy("file", F.floor((F.col("at") - 1) / FAN + 1).alias("up")).agg(nodes).select("file", F.col("up").alias("at"), F.unhex(joined).alias("digest"))
    count = lines.groupBy("file").agg(F.max("line_no").alias("lines"))
    return level.groupBy("file").agg(nodes).select("file", joined.alias("root")).join(count, "file")


def identity(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the identity of each file's content: the root of its tree of lines, with its size and number of lines. An empty file has the digest of nothing. ``listing`` (file, bytes, ...) and
    ``lines`` (file, line_no, line) call files alike."""
    tree = content_tree(lines).select(F.col("file").alias("_file"), "root", F.col("lines").alias("_lines"))
    whole = F.sha2(F.concat_ws(":", "root", "_lines", "bytes").cast("binary"), 256)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return listing.join(tree, F.col("file") == F.col("_file"), "left").select(*listing.columns, F.when(F.col("root").isNull(), nothing).otherwise(whole).alias("hash"))


def with_hash(spark: SparkSession, manifest: DataFrame, folder: str | Sequence[str]) -> DataFrame:
    """``identity`` of the files of a manifest. Files are read in splits, so their size does not matter."""
    listing = manifest.select(one_spelling("path").alias("file"), "bytes", "path")
    found = identity(listing, number_lines(spark.read.text(folder), full_path=True)).select("path", "hash")
    return manifest.join(found, "path", "left")


def new_files(hashed: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose content was never loaded; of equal contents in one batch only
    the first by name."""
    first = F.row_number().over(Window.partitionBy("hash").orderBy("file"))
    return hashed.join(seen.select("hash").distinct(), "hash", "left_anti").withColumn("_rn", first).filter(
        "_rn = 1").drop("_rn")


# --- lines ----------------------------------------------------------------------------
def number_lines(text: DataFrame, full_path: bool = False) -> DataFrame:
    """Physical line numbers (from 1) for a text read with file metadata. Files
    are called by name, or by ``full_path`` where names repeat across folders.

    Each split of a file numbers its own lines; splits are shifted by the lines
    of earlier splits of the same file. Only one small row per split is gathered."""
    path = F.col("_metadata.file_path")
    rows = text.select(
        (one_spelling(path) if full_path else F.element_at(F.split(path, "/"), -1)).alias("file"),
        F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"),
        F.regexp_replace("value", "^﻿", "").alias("line"))
    per_split = rows.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_from"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_split.select("file", "_at", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # within a split the ids are consecutive, so the number is a subtraction
    return rows.join(shifts, ["file", "_at"]).select(
        "file", (F.col("_seq") - F.col("_from") + F.col("_shift") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, paths: Sequence[str] | str, full_path: bool = False) -> DataFrame:
    return number_lines(spark.read.text(paths), full_path)


#: Stands for a separator inside quotes; a code point that no text uses.
MASK = "\ufdd0"


def field_count(line: str | Column, sep: str = ",") -> Column:
    """Fields of a line; separators inside quotes do not count."""
    c = F.col(line) if isinstance(line, str) else line
    bare = outside_quotes(c)
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def split_fields(line: str | Column, sep: str = ",") -> Column:
    """Fields of a line as an array of text, quotes removed. A separator counts
    only outside quotes: the line is cut at its quotes, separators in every second piece are masked, and the
    line is put together and cut at the separators that are left. Linear in the line."""
    c = F.col(line) if isinstance(line, str) else line
    inside = F.transform(F.split(c, '"', -1), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(sep), F.lit(MASK))).otherwise(p))
    parts = F.split(F.when(c.contains('"'), F.array_join(inside, '"')).otherwise(c), f"[{sep}]", -1)

    def plain(p: Column) -> Column:
        bare = F.trim(F.replace(p, F.lit(MASK), F.lit(sep)), F.lit(" \t\r\n"))
        closed = bare.startswith('"') & bare.endswith('"') & (F.length(bare) > 1)
        text = F.when(closed, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(F.replace(p, F.lit(MASK), F.lit(sep)))
        return F.when(p.contains('"'), F.replace(text, F.lit('""'), F.lit('"'))).otherwise(p)

    return F.transform(parts, plain)


# --- layout --------------------------------------------------------------------------------
def layout_stats(manifest: DataFrame, lines: DataFrame, columns: int = len(fixed.LAYOUT)) -> DataFrame:
    """Per file: data rows, header width, narrowest and widest row, anchors."""
    header = F.col("line_no") == 1
    body = ~header & (F.trim("line") != "")
    width = field_count("line")
    fields = split_fields("line")
    anchors = F.lit(True)
    for at, word in fixed.ANCHORS.items():
        anchors = anchors & F.coalesce(F.lower(F.trim(F.get(fields, at - 1))) == word.lower(), F.lit(False))
    stats = lines.groupBy("file").agg(
        F.count_if(body).alias("rows"), F.max(F.when(header, width)).alias("header_width"),
        F.min(F.when(body, width)).alias("min_width"), F.max(F.when(body, width)).alias("max_width"),
        F.max(F.when(header, anchors)).alias("anchors_ok"))
    return manifest.select("file").join(stats, "file", "left")


def validate_layout(manifest: DataFrame, lines: DataFrame, columns: int = len(fixed.LAYOUT)
                    ) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files, the latter with a reason (V-01)."""
    c = F.col
    reason = (
        F.when(c("header_width").isNull(), "empty file").when(c("header_width") != columns, "header column count")
        .when(~F.coalesce(c("anchors_ok"), F.lit(False)), "anchor headers")
        .when((c("min_width") != columns) | (c("max_width") != columns), "row column count"))
    judged = layout_stats(manifest, lines, columns).withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def header_mismatches(lines: DataFrame, expected: Sequence[str] = tuple(h for _, h in fixed.LAYOUT),
                      exempt: Sequence[int] = fixed.HEADER_EXEMPT) -> DataFrame:
    """Header names that differ from the expected ones (V-02, a warning)."""
    want = F.array(*[F.lit(h) for h in expected])
    heads = lines.filter("line_no = 1").select("file", F.posexplode(split_fields("line")))
    return heads.select("file", (F.col("pos") + 1).alias("position"), F.trim("col").alias("found"),
                        F.get(want, F.col("pos")).alias("expected")).filter(
        ~F.col("position").isin(*exempt) & ~F.lower("found").eqNullSafe(F.lower("expected")))


def load_raw(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """All-text rows of the accepted files: file, line number and 15 fields."""
    rows = lines.filter((F.col("line_no") > 1) & (F.trim("line") != "")).join(accepted.select("file"), "file", "left_semi")
    out = rows.select("file", "line_no", split_fields("line").alias("_f"))
    return stage(out.select("file", "line_no", *[F.get("_f", i).alias(c) for i, c in enumerate(fixed.RAW_COLUMNS)]))


def reconcile_load(raw: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of files that loaded completely, and the files that did not.
    ``counts`` has the rows counted while validating (file, rows)."""
    loaded = raw.groupBy("file").agg(F.count(F.lit(1)).alias("loaded"))
    off = counts.select("file", "rows").join(loaded, "file", "left").fillna(0, ["loaded"]).filter("rows <> loaded")
    return raw.join(off.select("file"), "file", "left_anti"), off


# --- shape of an unknown file ------------------------------------------------------------------
DELIMITERS = (",", ";", "\t", "|")


def guess_delimiter(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """Candidates scored by stability times width over the first lines; the first
    row is the choice. Only the head of the file is read."""
    head = spark.read.text(path).limit(lines).filter(F.trim("value") != "")
    widths = head.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("delimiter"), field_count("value", d).alias("width")) for d in DELIMITERS])).alias("w")).select("w.*")
    seen = widths.groupBy("delimiter", "width").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("width", F.struct("n", "width"))
    scored = seen.groupBy("delimiter").agg((F.max("n") / F.sum("n") * best).alias("score"), F.max("width").alias("widest"))
    rank = F.array_position(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("delimiter"))
    return scored.filter("widest >= 2").orderBy(F.desc("score"), rank).select("delimiter", "score")


def line_endings(spark: SparkSession, path: str) -> DataFrame:
    """Line ends, quoting, the risk of both together, and the encoding. Files are read in splits at line feeds, so their size does not matter."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    size = F.octet_length("value")
    returns = size - F.octet_length(F.replace("value", F.lit("\r"), F.lit("")))
    per_file = lines.groupBy("path", "bytes").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(size + 1).alias("_read"), F.count_if(F.col("value").endswith("\r")).alias("_ends"), F.sum(returns).alias("_cr"),
        F.max_by(F.col("value").endswith("\r"), "_at").alias("_last"), F.bool_or(F.col("value").contains('"')).alias("quoted"), F.bool_and(F.is_valid_utf8("value")).alias("_utf8"))
    # what follows the last line feed is not a line of its own if it is empty; else it has no line end
    open_end = F.col("_read") > F.col("bytes")
    crlf = F.col("_ends") - F.when(open_end & F.col("_last"), 1).otherwise(0)
    counted = per_file.withColumns({"crlf": crlf, "lf": F.col("_n") - open_end.cast("int") - crlf, "cr": F.col("_cr") - crlf})
    return counted.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "crlf", "cr", "lf", "quoted", ((F.col("crlf") > 0) & F.col("quoted")).alias("crlf_quote_risk"),
        F.when(F.col("_utf8"), "utf-8").otherwise("latin-1").alias("encoding"))


def profile_file(spark: SparkSession, path: str, sample: int | None = None) -> dict[str, DataFrame]:
    """Structure, column profiles, key candidates and anomalies of one file. The
    whole file is profiled unless a sample size is given."""
    found = guess_delimiter(spark, path).first()
    sep = found["delimiter"] if found else ","
    lines = read_lines(spark, path).filter(F.trim("line") != "")
    head = lines.filter("line_no = 1").first()
    if head is None:
        raise ValueError(f"{path} has no readable rows")
    names = spark.range(1).select(split_fields(F.lit(head["line"]), sep).alias("f")).first()["f"]
    names, width = [n.strip() for n in names], len(names)
    cols = [n or f"(unnamed {i + 1})" for i, n in enumerate(names)]
    cols = [c if cols.index(c) == i else f"{c} ({i + 1})" for i, c in enumerate(cols)]
    body = lines.filter("line_no > 1").select("line_no", field_count("line", sep).alias("_width"), split_fields("line", sep).alias("_f"))
    # the parsed table is written once, under plain names; every part of the profile reads it
    stored = write_once(body.select("line_no", "_width", *[F.coalesce(F.get("_f", i), F.lit("")).alias(f"c{i}") for i in range(width)]), "fields")
    rows = stored.orderBy("line_no").limit(sample) if sample else stored
    data = rows.select("line_no", *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
    text = [f"`{c}`" for c in cols]
    columns = prof.profile_columns(data.select(*text), cols).join(
        prof.column_examples(data.select("line_no", *text), ["line_no"], cols), "column_name", "left")
    columns = write_once(columns, "columns")  # one row per column, used by all that follows
    irregular = stored.filter(F.col("_width") != width).select("line_no", F.col("_width").alias("columns"))
    ends = line_endings(spark, path)
    anomalies = [
        irregular.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
            F.lit("irregular_columns").alias("anomaly"), F.lit("rechazo").alias("gravity"), F.col("n").cast("string").alias("detail")),
        ends.filter("crlf_quote_risk").select(F.lit("crlf_with_quotes").alias("anomaly"), F.lit("advertencia").alias("gravity"),
                                              F.col("crlf").cast("string").alias("detail")),
        columns.filter("type = 'vacia'").select(F.lit("empty_column").alias("anomaly"), F.lit("advertencia").alias("gravity"),
                                                F.col("column_name").alias("detail")),
    ]
    unnamed = [(("unnamed_header"), "advertencia", str(i + 1)) for i, n in enumerate(names) if not n]
    if unnamed:
        anomalies.append(spark.createDataFrame(unnamed, "anomaly string, gravity string, detail string"))
    found_all = anomalies[0]
    for a in anomalies[1:]:
        found_all = found_all.unionByName(a)
    return {
        "structure": ends.withColumns({"delimiter": F.lit(sep), "columns": F.lit(width)}),
        "columns": columns, "irregular": irregular, "keys": prof.key_candidates(data.select(*text), cols),
        "anomalies": found_all, "rules": prof.propose_rules(columns),
    }
