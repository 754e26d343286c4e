"""Every ready-made query against its SQL on the smallest tables, and what no plan may contain."""

import pytest

import __spark_entry__ as entry
from activity_engine.plans import ORACLES, QUERIES
from tests.oracle import difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert difference(spark, FOLDER, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["close_flag"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_orderdate" not in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderpriority:string>" in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = QUERIES["topk_per_group"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("Exchange"):] and "WindowGroupLimit" in plan
