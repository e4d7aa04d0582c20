"""Records over several lines, and one batch load."""

import csv
import datetime as dt
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.operators import batch
from plumbline.sources import files as fs, records
from plumbline.streaming import ingest

HEAD = ",".join(h for _, h in fixed.LAYOUT)
ROW = '{e},,-,NO,08/02/2013 18:30,-,{o},0,-,0,0,,"1.1.1.1,{b} 2.2.2.2",Chrome,Mac'


def text(*rows, head=HEAD, end="\r\n"):
    return end.join([head, *rows]) + end


@pytest.fixture
def splits_of(spark):
    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield set_
    for c, v in old.items():
        spark.conf.set(c, v)


def by_hand(body: str):
    """Records and their first lines, by the standard library: a record ends where the reader has read it."""
    lines = io.StringIO(body, newline="").readlines()
    reader, out, at = csv.reader(iter(lines)), [], 0
    for _ in reader:
        out.append((at + 1, reader.line_num - at, "".join(lines[at:reader.line_num]).removesuffix("\n")))
        at = reader.line_num
    return out


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", 0, 1), ('a,"b', 1, 0), ('"a"', 0, 0), ('"a""b', 1, 0), ('5" pipe,x', 0, 0), ('"a"b"c,', 0, 0), ('"a","b', 1, 1), ('""', 0, 1), ('"""', 1, 0), ("", 0, 1), (',"', 1, 0), ('x"', 0, 0)])
def test_maps_of_lines(line, outside, inside):
    assert (records.end_of_line(line, 0), records.end_of_line(line, 1)) == (outside, inside)
    assert records.end_of_line(line, 0) == (by_hand(line + "\nz\n")[0][1] == 2)


@pytest.mark.parametrize("seed", range(3))
def test_records_of_any_splits(spark, splits_of, tmp_path, seed):
    rng = random.Random(seed)
    for name in "ab":
        body = "".join(rng.choice(['"', '"', ",", "\n", "x", "yz", '""', '"q,\nq"', "word,\n", ' , "\n']) for _ in range(200)) + "end\n"
        (tmp_path / name).write_text(body)
    want = {(n, *r) for n in "ab" for r in by_hand((tmp_path / n).read_text())}
    for size in (23, 1 << 20):
        splits_of(size)
        got = records.read_records(spark.read.text(str(tmp_path)))
        assert {(r.file, r.line_no, r.lines, r.line) for r in got.collect()} == want


def test_one_long_file_is_cut_by_many_tasks(spark, splits_of, tmp_path):
    body = "".join(f'{i},"line {i}\nand ""more""\n",x\n' for i in range(1500))
    (tmp_path / "long").write_bytes(("﻿" + body).encode().replace(b"\n", b"\r\n"))
    splits_of(2048)
    source = spark.read.text(str(tmp_path))
    got = records.read_records(source)
    rows = sorted((r.line_no, r.lines, r.line) for r in got.collect())
    assert source.select(F.spark_partition_id().alias("p")).distinct().count() > 20
    assert rows == [(3 * i + 1, 3, f'{i},"line {i}\nand ""more""\n",x') for i in range(1500)]
    fields = got.select(fs.split_fields("line").alias("f"), fs.field_count("line").alias("n"))
    assert fields.where("n <> 3").count() == 0 and fields.where("f[0] = '7'").first().f[1] == 'line 7\nand "more"\n'


def test_quotes_that_are_never_closed(spark, splits_of, tmp_path):
    (tmp_path / "open").write_text('a\nb,"c\n' + "d\n" * 50)
    splits_of(8)
    assert sorted((r.line_no, r.lines) for r in records.read_records(spark.read.text(str(tmp_path))).collect()) == [(1, 1), (2, 51)]
    (tmp_path / "open").write_text("")
    assert records.read_records(spark.read.text(str(tmp_path))).collect() == []


def test_identity_does_not_depend_on_splits(spark, splits_of, tmp_path, monkeypatch):
    monkeypatch.setattr(fs, "FAN", 7)
    body = "".join(f"line {i}\n" for i in range(500))
    for n, b in {"report_1.txt": body, "report_2.txt": body, "report_3.txt": body[:-2] + "x\n", "report_4.txt": body[:-1], "report_5.txt": "", "report_6.txt": body.replace("line 3\nline 4\n", "line 4\nline 3\n")}.items():
        (tmp_path / n).write_text(b)
    seen = []
    for size in (64, 1 << 20):
        splits_of(size)
        seen.append({r.file: r.hash for r in fs.with_hash(spark, fs.file_manifest(spark, str(tmp_path)), str(tmp_path)).collect()})
    assert seen[0] == seen[1] and seen[0]["report_1.txt"] == seen[0]["report_2.txt"] and len(set(seen[0].values())) == 5


# --- one load -------------------------------------------------------------------------------------------------------------

LATER = "2999-01-01 00:00:00"


def inbox(folder, **named):
    folder.mkdir(exist_ok=True)
    for n, body in named.items():
        (folder / f"report_{n.removeprefix('r')}.txt").write_bytes(body.encode())
    return str(folder)


def first_files(folder):
    good = text(ROW.format(e="a@b.co", o=1, b="\r\n"), ROW.format(e="a@b.co", o=3, b=""), "", ROW.format(e="bad", o=2, b=""), ROW.format(e="c@d.co", o="abc", b=""))
    renamed = text(ROW.format(e="g@h.co", o=9, b=""), head=HEAD.replace("Opens,", "Aperturas,"))
    return inbox(folder, r1=good, r2=good, r3=text("a,b,c"), r4="", r5=renamed, r6=text(ROW.format(e="x@y.co", o=1, b=""), head=HEAD.replace("email", "mail")))


def targets(store):
    return {t: sorted(map(str, store.table(t).drop("id_ejecucion", "hash_archivo", "_first", "_last").collect())) for t in batch.TABLES}


def test_a_load_from_end_to_end(spark, tmp_path):
    store = batch.Store(spark, str(tmp_path / "out")).create()
    assert store.table("statistics").collect() == [] and store.table("files").collect() == []
    run = batch.load(store, first_files(tmp_path / "in"), LATER)
    r = store.runs().where(F.col("id_ejecucion") == run).first()
    assert (r.estatus, r.archivos_detectados, r.archivos_omitidos, r.archivos_cargados, r.archivos_rechazados) == ("OK_CON_ADVERTENCIAS", 6, 1, 2, 3)
    assert (r.registros_leidos, r.registros_cargados, r.mensaje) == (5, 3, None) and r.duracion_segundos >= 0 and r.fecha_fin >= r.fecha_inicio
    said = {(i.nombre_archivo, i.codigo_error, i.line_no, i.campo) for i in store.table("incidents").collect() if i.codigo_error != "V-09"}
    assert said == {("report_3.txt", "V-01", None, "layout"), ("report_4.txt", "V-01", None, "layout"), ("report_6.txt", "V-01", None, "layout"), ("report_3.txt", "BR-037", None, "layout"), ("report_4.txt", "BR-039", None, "layout"),
                    ("report_6.txt", "BR-038", 1, "layout"), ("report_5.txt", "BR-038", 1, "layout"), ("report_5.txt", "V-02", 1, "Opens"), ("report_1.txt", "V-07", 2, "email + Fecha envio"), ("report_1.txt", "V-03", 6, "email"),
                    ("report_1.txt", "V-06", 7, "Opens / Clicks")}
    assert r.registros_error == 4 and {s.email: s.opens for s in store.table("statistics").collect()} == {"a@b.co": 3, "c@d.co": 0, "g@h.co": 9}
    # nothing is new a second time, under any name
    again = inbox(tmp_path / "in", r7=text(ROW.format(e="g@h.co", o=9, b=""), head=HEAD.replace("Opens,", "Aperturas,")))
    was = targets(store)
    run = batch.load(store, again, LATER)
    r = store.runs().where(F.col("id_ejecucion") == run).first()
    assert (r.estatus, r.archivos_detectados, r.archivos_omitidos, r.archivos_cargados, r.registros_leidos) == ("OK", 7, 7, 0, 0) and targets(store) == was
    # a later load merges, a snapshot changes nothing
    inbox(tmp_path / "more", r8=text(ROW.format(e="A@b.co", o=2, b=""), ROW.format(e="n@b.co", o=1, b="")))
    batch.load(store, str(tmp_path / "more"), LATER)
    was = targets(store)
    assert {s.email: s.opens for s in store.table("statistics").collect()} == {"a@b.co": 3, "c@d.co": 0, "g@h.co": 9, "n@b.co": 1}
    store.compact()
    assert targets(store) == was and len(store.parts()) == 1


def test_quiet_files_only(spark, tmp_path):
    folder = inbox(tmp_path / "in", r1=text(ROW.format(e="a@b.co", o=1, b="")), r2=text(ROW.format(e="b@b.co", o=1, b="")))
    now = dt.datetime.now(dt.timezone.utc)
    os.utime(tmp_path / "in" / "report_1.txt", (now.timestamp() - 3600,) * 2)
    store = batch.Store(spark, str(tmp_path / "out")).create()
    batch.load(store, folder, now.strftime("%Y-%m-%d %H:%M:%S"))
    assert [r.email for r in store.table("statistics").collect()] == ["a@b.co"]


@pytest.mark.parametrize("broken", ["visits", "incidents", "files"])
def test_a_load_that_dies_between_two_writes(spark, tmp_path, monkeypatch, broken):
    folder = first_files(tmp_path / "in")
    clean = batch.Store(spark, str(tmp_path / "clean")).create()
    batch.load(clean, folder, LATER)
    store, write = batch.Store(spark, str(tmp_path / "out")).create(), batch._write

    def dies(df, path):
        if path.endswith(broken):
            raise OSError("the disk is gone")
        write(df, path)

    monkeypatch.setattr(batch, "_write", dies)
    with pytest.raises(OSError):
        batch.load(store, folder, LATER)
    monkeypatch.undo()
    assert all(store.table(t).count() == 0 for t in batch.TABLES)
    r = store.runs().first()
    assert (r.estatus, r.mensaje) == ("FALLIDO", "the disk is gone")
    batch.load(store, folder, LATER)
    assert targets(store) == targets(clean) and [r.estatus for r in store.runs().orderBy("id_ejecucion").collect()] == ["FALLIDO", "OK_CON_ADVERTENCIAS"]


def test_a_failed_control_point_leaves_nothing(spark, tmp_path, monkeypatch):
    store = batch.Store(spark, str(tmp_path / "out")).create()
    lost = batch.etl.rank_sends
    monkeypatch.setattr(batch.etl, "rank_sends", lambda df: lost(df).where("line_no <> 2"))
    batch.load(store, inbox(tmp_path / "in", r1=text(ROW.format(e="a@b.co", o=1, b=""), ROW.format(e="b@b.co", o=1, b=""))), LATER)
    r = store.runs().first()
    assert r.estatus == "FALLIDO" and "PC-5 staged = work: 1" in r.mensaje and "PC-6" in r.mensaje
    assert all(store.table(t).count() == 0 for t in batch.TABLES)


def test_one_load_at_a_time_and_one_winner_of_a_version(spark, tmp_path):
    store = batch.Store(spark, str(tmp_path / "out")).create()
    store._append(kind="open", attempt="other", id_ejecucion=1, estatus="EN_CURSO", fecha_inicio=batch._now())
    with pytest.raises(batch.Busy):
        batch.load(store, first_files(tmp_path / "in"), LATER)
    store._append(version=1, kind="load", attempt="aaa", id_ejecucion=1, estatus="FALLIDO")
    store._append(version=1, kind="load", attempt="bbb", id_ejecucion=2, estatus="OK")
    assert [r.attempt for r in store.log().where("version = 1").collect()] == ["aaa"]


def test_the_stream_skips_a_twin_and_loads_a_batch_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    one = text(ROW.format(e="a@b.co", o=5, b="\r\n"))
    inbox(src, r1=one, r2=text("short,row"))
    run = lambda: ingest.ingest_stream(spark, str(src), out, str(tmp_path / "ckpt"), per_batch=1).awaitTermination()
    run()
    inbox(src, r3=one, r4=text(ROW.format(e="n@b.co", o=1, b="")))
    run()
    assert {r.email: r.opens for r in ingest.current(spark, out, "statistics").collect()} == {"a@b.co": 5, "n@b.co": 1}
    files = {r.nombre_archivo.split("/")[-1]: r.estatus for r in ingest.current(spark, out, "files").collect()}
    assert files == {"report_1.txt": "CARGADO", "report_2.txt": "RECHAZADO", "report_4.txt": "CARGADO"}
    text_ = spark.read.text(str(src / "report_1.txt")).select("value", "_metadata")
    ingest.process_batch(text_, 0, out, LATER)
    assert batch.Store(spark, out).runs().count() == 4
    # an attempt that broke off is done again in its place
    store = batch.Store(spark, str(tmp_path / "again")).create()
    store._append(kind="open", attempt="batch-0", id_ejecucion=1, estatus="EN_CURSO", fecha_inicio=batch._now())
    spark.range(3).write.parquet(str(tmp_path / "again/data/batch-0/statistics"))
    ingest.process_batch(text_, 0, str(tmp_path / "again"), LATER)
    assert [r.opens for r in store.table("statistics").collect()] == [5]
