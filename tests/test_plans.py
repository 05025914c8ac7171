"""Physical-plan properties that the design relies on at scale."""

import os
import re

import pytest

import __spark_entry__ as E
from salespanel.plans.queries import QUERIES as PANEL_QUERIES

SF = "/root/testdata/sf0.001"
MODEL_QUERIES = {"ridge_metrics", "forest_metrics", "model_comparison", "model_selection", "forecast_by_date"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan_of(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(PANEL_QUERIES) - MODEL_QUERIES))
def test_no_cross_products_or_python(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_lag_family_is_one_window(spark):
    plan = plan_of(E.queries()["feature_table"](spark, SF))
    assert len(re.findall(r"\bWindow \[lag\(", plan)) == 1  # the rank walk of the medians has its own


def test_per_column_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(E.queries()["markdown_outliers"](spark, SF))
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_global_top_k_is_take_ordered(spark):
    for name in ("zero_sales", "negative_sales", "wow_anomalies", "dept_top10", "holiday_spikes"):
        assert "TakeOrderedAndProject" in plan_of(E.queries()[name](spark, SF)), name


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(E.queries()["kpis"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("MarkDown" not in s and "CPI" not in s for s in schemas)


def test_correlation_aggregate_is_code_generated(spark):
    plan = plan_of(E.queries()["markdown_corr"](spark, SF), executed=True)
    final = plan.split("== Initial Plan ==")[0]
    aggs = [line for line in final.splitlines() if "HashAggregate(" in line]
    assert aggs and all("*(" in line for line in aggs)
