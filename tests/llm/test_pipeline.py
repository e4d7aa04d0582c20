from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from llm.common import prose
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    assert compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_all_are_registered():
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries()) and len(queries.QUERIES) == 13


def write(folder, documents, benchmark):
    con = duckdb.connect()
    for name, kind, rows in (("documents", "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint", documents), ("benchmark", "item_id bigint, text varchar", benchmark),
                             ("conversations", "conv_id bigint, turn bigint, role varchar, text varchar", [])):
        con.execute(f"CREATE TABLE {name} ({kind})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_stages_take_effect(spark, tmp_path):
    clean = [(i, prose(i, 60)) for i in range(50)]
    item = prose(777, 30)
    bad = [(100, "123 !!!"), (101, clean[3][1]), (102, None), (103, clean[4][1] + " " + item), (104, clean[5][1] + " token = 0123456789abcdef0123456789abcdef " + prose(88, 50))]
    write(tmp_path, [(i, t, "xx", "src", len(t or "")) for i, t in clean + bad], [(1, item)])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        kept.append({r.doc_id for r in docs.collect()})
    ids = set(range(50))
    assert kept[0] == ids | {101, 103, 104} and kept[1] == ids | {103, 104} and kept[2] == kept[3] == ids | {104}
    assert "0123456789abcdef" not in docs.where("doc_id = 104").first().text and docs.where("doc_id < 100").count() == 50
    assert {(r.doc_id, r.text) for r in docs.where("doc_id < 100").collect()} == set(clean)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids | {104}


def test_empty_corpus(spark, tmp_path):
    write(tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
