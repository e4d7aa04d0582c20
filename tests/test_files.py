import datetime as dt
import os

import pytest

from plumbline.functions import fixed
from plumbline.operators import etl
from plumbline.sources import files as fs
from plumbline.streaming import ingest

HEAD = ",".join(h for _, h in fixed.LAYOUT)
ROW = '{e},,-,NO,08/02/2013 18:30,-,{o},0,-,0,0,,"1.1.1.1, 2.2.2.2",Chrome,Mac'


def text(*rows, head=HEAD, end="\r\n"):
    return end.join([head, *rows]) + end


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    good = text(ROW.format(e="a@b.co", o=1), ROW.format(e="c@d.co", o=2), "", ROW.format(e="e@f.co", o=3))
    (d / "report_1.txt").write_bytes(good.encode())
    (d / "report_2.txt").write_bytes(good.encode())
    (d / "report_3.txt").write_bytes(text("a,b,c").encode())
    (d / "report_4.txt").write_bytes(b"")
    (d / "report_5.txt").write_bytes(text(ROW.format(e="g@h.co", o=9), head=HEAD.replace("Opens,", "Aperturas,").replace("jyv", "fgh")).encode())
    (d / "notes.txt").write_text("x")
    return d


def test_manifest_identity_and_quiet_period(spark, folder):
    man = fs.file_manifest(spark, str(folder))
    assert [r["file"] for r in man.orderBy("file").collect()] == [f"report_{i}.txt" for i in range(1, 6)]
    hashed = fs.with_hash(spark, man, str(folder))
    seen = hashed.filter("file = 'report_3.txt'").select("hash")
    assert {r["file"] for r in fs.new_files(hashed, seen).collect()} == {"report_1.txt", "report_4.txt", "report_5.txt"}
    now = dt.datetime.now(dt.timezone.utc)
    os.utime(folder / "report_1.txt", (now.timestamp() - 3600,) * 2)
    quiet = fs.quiet_files(man, now.strftime("%Y-%m-%d %H:%M:%S"))
    assert [r["file"] for r in quiet.collect()] == ["report_1.txt"]


def test_layout_and_raw_load(spark, folder):
    man, lines = fs.file_manifest(spark, str(folder)), fs.read_lines(spark, str(folder))
    good, bad = fs.validate_layout(man, lines)
    assert {r["file"] for r in good.collect()} == {"report_1.txt", "report_2.txt", "report_5.txt"}
    assert {r["file"]: r["reason"] for r in bad.collect()} == {"report_3.txt": "row column count", "report_4.txt": "empty file"}
    raw = fs.load_raw(lines, good)
    one = raw.filter("file = 'report_1.txt'").orderBy("line_no").collect()
    assert [r["line_no"] for r in one] == [2, 3, 5] and one[0]["ips"] == "1.1.1.1, 2.2.2.2" and one[0]["plataformas"] == "Mac"
    kept, off = fs.reconcile_load(raw, good)
    assert off.count() == 0 and kept.count() == 7
    kept, off = fs.reconcile_load(raw.filter("line_no <> 5"), good)
    assert {r["file"] for r in off.collect()} == {"report_1.txt", "report_2.txt"} and kept.count() == 1


def test_header_names(spark, folder):
    found = fs.header_mismatches(fs.read_lines(spark, str(folder / "report_5.txt"))).collect()
    assert [(r["position"], r["found"]) for r in found] == [(7, "Aperturas")]


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "report_9.txt"
    path.write_text("\n".join(f"row {i}" for i in range(1, 4001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = fs.read_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4000 and all(r["line"] == f"row {r['line_no']}" for r in rows)


def test_shape_of_a_file(spark, folder):
    ends = fs.line_endings(spark, str(folder / "report_1.txt")).first()
    assert (ends["crlf"], ends["cr"], ends["lf"], ends["crlf_quote_risk"], ends["encoding"]) == (5, 0, 0, True, "utf-8")
    assert fs.guess_delimiter(spark, str(folder / "report_1.txt")).first()["delimiter"] == ","
    other = folder / "semi.csv"
    other.write_bytes("id;name\n1;é\n2;b,c\n".encode("latin-1"))
    assert fs.guess_delimiter(spark, str(other)).first()["delimiter"] == ";"
    assert fs.line_endings(spark, str(other)).first()["encoding"] == "latin-1"


def test_profile_of_a_file(spark, folder):
    out = fs.profile_file(spark, str(folder / "report_1.txt"))
    kinds = {r["column_name"]: r["type"] for r in out["columns"].collect()}
    assert kinds["email"] == "email" and kinds["Fecha envio"] == "fecha" and kinds["Opens"] == "entero" and kinds["jyv"] == "vacia"
    email = out["columns"].filter("column_name = 'email'").first()
    assert email["examples"] == ["a@b.co", "c@d.co", "e@f.co"] and email["pct_present"] == 100.0
    assert {r["anomaly"] for r in out["anomalies"].collect()} == {"crlf_with_quotes", "empty_column"}
    assert ["email"] in [[r["columns"]] for r in out["keys"].collect()]
    assert {r["severity"] for r in out["rules"].filter("column_name = 'Fecha envio'").collect()} == {"RECHAZO"}


def test_irregular_lines_are_listed(spark, folder):
    assert fs.profile_file(spark, str(folder / "report_3.txt"))["irregular"].collect()[0]["columns"] == 3


def test_stream_picks_up_new_files_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    (src / "report_1.txt").write_text(text(ROW.format(e="a@b.co", o=5), ROW.format(e="bad", o=1)))
    run = lambda: ingest.ingest_stream(spark, str(src), out, ckpt).awaitTermination()
    run()
    run()
    (src / "report_2.txt").write_text(text(ROW.format(e="A@b.co", o=2), ROW.format(e="n@b.co", o=1)))
    (src / "report_3.txt").write_text(text("short,row"))
    run()
    rows = {r["email"]: r["opens"] for r in ingest.current(spark, out, "statistics").collect()}
    assert rows == {"a@b.co": 5, "n@b.co": 1}
    said = [r["codigo_error"] for r in ingest.current(spark, out, "incidents").collect()]
    assert said.count("V-03") == 1 and said.count("V-01") == 1
    ingest.compact(spark, out)
    again = {r["email"]: r["opens"] for r in ingest.current(spark, out, "statistics").collect()}
    assert again == rows


def test_typed_layer_needs_no_clean_text(spark, folder):
    lines = fs.read_lines(spark, str(folder / "report_1.txt"))
    good, _ = fs.validate_layout(fs.file_manifest(spark, str(folder)), lines)
    raw = fs.load_raw(lines, good)
    typed = etl.type_records(raw, ("file", "line_no"))
    assert typed.filter("email_ok AND numericos_ok").count() == 3
