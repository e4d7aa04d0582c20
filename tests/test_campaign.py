import random
from collections import Counter

from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.operators import etl, monitor, rules, windows

BASE = dict(email="a@b.co", jyv=None, badmail="-", baja="NO", fecha_envio="08/02/2013 18:30", fecha_open="-", opens="0", opens_virales="0",
            fecha_click="-", clicks="0", clicks_virales="0", links="", ips="-", navegadores="-", plataformas="-")


def ranked(spark, *rows):
    data = [(r.get("file_id", 1), r.get("line_no", i + 2), *[{**BASE, **r}[c] for c in fixed.RAW_COLUMNS]) for i, r in enumerate(rows)]
    schema = "file_id long, line_no long, " + ", ".join(f"{c} string" for c in fixed.RAW_COLUMNS)
    return etl.rank_sends(etl.type_records(etl.stage(spark.createDataFrame(data, schema))))


def codes(df):
    return [r["codigo_error"] for r in rules.record_incidents(df).orderBy("line_no", "codigo_error").collect()]


def test_each_load_rule(spark):
    for row, want in (
        ({}, []), ({"email": "x@y"}, ["V-03"]), ({"email": ""}, ["V-03"]), ({"fecha_envio": "2013-02-08 18:30"}, ["V-04"]),
        ({"fecha_open": "31/31/2013 10:00"}, ["V-05"]), ({"opens": "abc"}, ["V-06"]), ({"opens": "-"}, ["V-06"]),
        ({"fecha_open": "08/02/2013 17:00", "opens": "1"}, ["V-08"]), ({"fecha_click": "08/02/2013 17:00"}, []),
        ({"clicks": "1", "fecha_click": "08/02/2013 19:00"}, ["V-10"]),
    ):
        assert codes(ranked(spark, row)) == want, row


def test_twins_keep_the_fuller_row(spark):
    df = ranked(spark, {"opens": "1"}, {"opens": "3", "email": "A@B.co"})
    assert codes(df) == ["V-07"]
    assert etl.statistics(df).first()["opens"] == 3


def test_equal_twins_have_one_winner(spark):
    rows = [{"file_id": f, "line_no": 7} for f in (1, 2)]
    for order in (rows, rows[::-1]):
        assert ranked(spark, *order).filter("rn = 1").first()["file_id"] == 2


def test_empty_columns_and_catalogue(spark):
    found = {r["campo"] for r in rules.file_incidents(ranked(spark, {})).collect()}
    assert "jyv" in found and "baja" not in found
    cat = monitor.catalogue(spark)
    used = {r["codigo_error"]: r["times_seen"] for r in monitor.catalogue_usage(cat, rules.incidents(ranked(spark, {"email": "x@y"}))).collect()}
    assert len(used) == 10 and used["V-03"] == 1 and used["V-01"] == 0


def test_visit_grain(spark):
    two = ranked(spark, {"clicks": "2", "fecha_click": "09/02/2013 10:00"}, {"clicks": "1", "fecha_click": "09/02/2013 10:01", "file_id": 2})
    assert etl.statistics(two).count() == 1
    assert [r["clicks"] for r in etl.visits(two).orderBy("fecha_visita").collect()] == [2, 1]
    total = etl.build_visitors(etl.visits(two), "2013-02-20").first()
    assert (total["visitasTotales"], total["visitasAnioActual"], total["visitasMesActual"]) == (3, 3, 3)
    same = ranked(spark, {"clicks": "1", "fecha_click": "09/02/2013 10:00"}, {"clicks": "2", "fecha_click": "09/02/2013 10:00"})
    assert [r["clicks"] for r in etl.visits(same).collect()] == [2]


def test_later_batch_erases_dates_but_not_counters(spark):
    one = etl.statistics(ranked(spark, {"opens": "5", "fecha_open": "08/02/2013 19:00", "links": "4"}))
    two = ranked(spark, {"opens": "1", "file_id": 9})
    erased = etl.statistics(two, target=one).first()
    assert erased["fecha_open"] is None and erased["opens"] == 5 and erased["file_id"] == 1
    kept = etl.statistics(two, target=one, keep_nulls=False).first()
    assert kept["fecha_open"] is not None and kept["links"] == "4"


def test_business_rules(spark):
    def br(*rows):
        return {r["codigo_error"] for r in rules.br_findings(ranked(spark, *rows)).collect()}
    assert {"BR-001"} <= br({"opens": "2"}) and "BR-042" in br({"opens": "abc"}) and "BR-042" not in br({"opens": "-"})
    assert {"BR-005", "BR-008"} <= br({"clicks": "1", "fecha_click": "08/02/2013 19:00"})
    assert "BR-025" in br({"fecha_click": "08/02/2013 17:00"}) and "BR-040" in br({"email": ""}) and "BR-041" in br({"email": "x@y"})
    assert {"BR-023", "BR-043"} <= br({"fecha_envio": "soon"})
    twice = br({"opens": "1", "file_id": 1}, {"opens": "2", "file_id": 2})
    assert {"BR-029", "BR-030", "BR-032", "BR-033", "BR-034", "BR-036", "BR-045"} <= twice and "BR-035" not in twice
    assert {"BR-031", "BR-044"} <= br({}, {}) and "BR-032" not in br({}, {})


def test_scenarios(spark):
    assert len(rules.scenario_conditions()) == 58
    labels = {r["label"] for r in rules.scenario_labels(ranked(spark, {})).collect()}
    assert {"OPEN_NONE", "CLICK_NONE", "COMPLETELY_INACTIVE", "ALL_METADATA_ABSENT", "NO_RECORDED_ENGAGEMENT"} == labels - {"METADATA_ABSENT"}


def test_rank_of_a_hot_key_is_exact(spark):
    """A third of the rows share one key; pieces must add up to the plain ranking."""
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 50)}", rnd.randint(0, 3), i, rnd.random() > 0.1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, score int, line long, good boolean").repartition(7)
    got = windows.rank_best(df, ["k"], [F.desc("score"), F.desc("line")], F.col("good"), [-F.col("score"), -F.floor(F.col("line") / 100)])
    want, seen = {}, Counter()
    for k, _, line, good in sorted(rows, key=lambda r: (-r[1], -r[2])):
        if good:
            seen[k] += 1
        want[line] = seen[k] if good else None
    assert {r["line"]: r["rn"] for r in got.collect()} == want
    plain = windows.rank_best(df, ["k"], [F.desc("score"), F.desc("line")], F.col("good"))
    assert {r["line"]: r["rn"] for r in plain.collect()} == want


def test_surrogate_keys_are_dense(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(9)
    rows = windows.surrogate_key(df, ["v"], "key").orderBy("v").collect()
    assert [r["key"] for r in rows] == list(range(1, 5001))


def test_run_health_without_rows_read(spark):
    runs = spark.createDataFrame([(1, "OK", 0, 5, 0, 0), (2, "OK", 100, 6, 0, 0), (3, "FALLIDO", 10, 0, 0, 0), (4, "OK", 250, 4, 0, 0), (5, "OK", 10, 0, 0, 0)],
                                 "id_ejecucion long, estatus string, registros_leidos long, registros_error long, registros_advertencia long, archivos_rechazados long")
    lights = [r["semaforo"] for r in monitor.run_health(runs).orderBy("id_ejecucion").collect()]
    assert lights == ["AMARILLO", "ROJO", "ROJO", "AMARILLO", "VERDE"]


def test_diagnosis_of_four_runs(spark):
    runs = spark.createDataFrame(
        [(1, "OK", 3, 3, 2005, 0, ""), (2, "FALLIDO", 1, 1, 100, 0, "boom"), (3, "OK", 2, 0, 0, 0, ""), (4, "OK", 1, 1, 250, 4, "")],
        "id_ejecucion long, estatus string, archivos_detectados long, archivos_cargados long, registros_leidos long, registros_error long, mensaje string"
    ).withColumn("fecha_inicio", F.lit("2024-01-01").cast("timestamp_ntz"))
    files = spark.createDataFrame([(1, 11, "a", 2005, "PURGADO_ORIGEN", ""), (2, 12, "b", 100, "PURGADO_ORIGEN", ""), (4, 14, "d", 250, "PURGADO_ORIGEN", "")],
                                  "id_ejecucion long, file_id long, nombre_archivo string, registros_leidos long, estatus string, motivo_rechazo string")
    target = spark.createDataFrame([(11,), (14,)], "file_id long")
    said = spark.createDataFrame([(4, "a,b,c")], "id_ejecucion long, registro_completo string")
    got = {(r["id_ejecucion"], r["finding"]) for r in monitor.diagnose(runs, files, target, said).collect()}
    assert got == {(2, "run_failed"), (2, "purged_not_loaded"), (3, "nothing_loaded"), (4, "audit_incomplete")}
