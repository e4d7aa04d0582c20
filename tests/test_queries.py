"""All registered queries against DuckDB. Those of the training-data operators are in tests/llm."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.ORACLES)
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"country", "margin_tier", "total_revenue", "revenue_share_pct", "transactions"} == set(rows[0].asDict())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["orphans_of_lineitem", "revenue_share_by_country", "dedup_report", "share_within_region",
                                  "row_level_security_all", "emails_in_several_files", "silhouette_of_labels", "enriched_view"])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dedup_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["deduplicated_fact_with_bands"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["sales_by_country_and_year"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "c_mktsegment" not in plan
