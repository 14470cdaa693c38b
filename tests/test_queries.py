"""Every registered query against its SQL, and what no plan may contain."""

import pytest

import __spark_entry__ as entry
from merchlens.plans import QUERIES
from tools import verify

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return verify.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    ok, note = verify.compare(spark, duck, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_product_joins_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in plan, f"{name} uses {operator}"


def test_trend_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["trends_by_category"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "l_shipdate" not in plan and "o_totalprice" not in plan


def test_cached_texts_are_judged_below_the_join_with_items(spark):
    plan = entry.queries()["cache_lookup_versioned"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "cached_text" not in plan.splitlines()[0]
