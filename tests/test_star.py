import datetime as dt

from plumbline.plans.standins import World


def test_lines_of_the_fact_move_once(spark, tmp_path):
    """Tables too large to be sent whole: the lines are shuffled for one join, not for two."""
    at = dt.datetime(2024, 1, 2)
    tables = {
        "customer": ([(1, "c", 3, 1.0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(7, 1, "O", 1.0, at, "2-HIGH"), (8, 9, "O", 1.0, at, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(7, 5, 2, n, 2.0, 10.0, 0.1, 0.0, "N", "O", at) for n in (1, 1, 2)] + [(8, 5, 2, 1, 2.0, 10.0, 0.1, 0.0, "N", "O", at), (None, 5, 2, 1, 2.0, 10.0, 0.1, 0.0, "N", "O", at)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = World(spark, str(tmp_path)).fact
        plan = fact._jdf.queryExecution().explainString(fact._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [part for part in plan.split("\n\n") if ") Exchange" in part and "l_extendedprice" in part]
        assert len(moved) == 1
        assert sorted(r["transactionid"] for r in fact.collect()) == ["7-1", "7-1", "7-2"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
