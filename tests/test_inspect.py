"""Micro-inspection and BI edge rules."""

import datetime as dt

from pyspark.sql import functions as F

from salespanel.operators import insight
from salespanel.operators import inspect as insp
from salespanel.operators import profile as prof
from tests.conftest import CLEAN_DDL, d, series_rows


def test_prev_week_zero_rules(spark):
    rows = series_rows(store=1, sales=[0.0, 5.0, 6.0, 3.0], md1=[None] * 4) \
        + series_rows(store=2, sales=[0.0, 0.0, 1.0], md1=[None] * 3)
    df = spark.createDataFrame(rows, CLEAN_DDL)
    w = {(r.Store, r.Date): r.pct_change for r in insp.wow_change(df).collect()}
    assert w[(1, d("2010-01-08"))] == float("inf")
    assert w[(2, d("2010-01-08"))] is None          # 0 -> 0
    assert w[(2, d("2010-01-15"))] == float("inf")
    top = insp.wow_anomalies(df).collect()
    assert top[0].pct_change == float("inf") and (top[0].Store, top[0].Date) == (1, d("2010-01-08"))
    assert all(r.pct_change is not None for r in top)
    assert len(top) == 4   # store 1: 3 changes; store 2: 1 (the 0/0 is dropped)


def test_constant_column_correlation_is_null(spark):
    rows = series_rows(sales=[float(i) for i in range(10)], md1=[1.0] * 10)
    df = spark.createDataFrame(rows, CLEAN_DDL)
    c = {(r.col_a, r.col_b): r.corr for r in insight.markdown_corr(df).collect()}
    assert c[("MarkDown1", "Weekly_Sales")] is None
    assert c[("Weekly_Sales", "Weekly_Sales")] == 1.0
    assert c[("MarkDown2", "Weekly_Sales")] is None   # all null


def test_store_without_holiday_rows_is_absent(spark):
    rows = series_rows(store=1, holidays=[True] + [False] * 11) + series_rows(store=2)
    df = spark.createDataFrame(rows, CLEAN_DDL)
    got = insp.holiday_spikes(df).collect()
    assert [r.Store for r in got] == [1]
    assert got[0].spike_ratio == got[0].holiday_mean / got[0].non_holiday_mean


def test_markdown_outliers_cap(spark):
    # columns 1-3 each have 6 far outliers -> 5 per column, 15 in total: columns 4-5 never appear
    rows = []
    for i in range(40):
        big = 1e6 + i if i < 6 else 1.0 + (i % 3)
        rows.append((1, i, d("2010-01-01"), 1.0, False, "A", 1, 1.0, 1.0, big, big, big, big, big, 1.0, 1.0))
    df = spark.createDataFrame(rows, CLEAN_DDL)
    out = insp.markdown_outliers(df).collect()
    assert len(out) == 15
    assert [r.md_column for r in out] == ["MarkDown1"] * 5 + ["MarkDown2"] * 5 + ["MarkDown3"] * 5
    assert [r.value for r in out[:5]] == [1e6 + 5, 1e6 + 4, 1e6 + 3, 1e6 + 2, 1e6 + 1]


def test_iqr_linear_interpolation(spark):
    rows = [(1, i, d("2010-01-01"), 1.0, False, "A", 1, 1.0, 1.0, v, None, None, None, None, 1.0, 1.0)
            for i, v in enumerate([1.0, 2.0, 3.0, 10.0])]
    b = insp.markdown_iqr_bounds(spark.createDataFrame(rows, CLEAN_DDL)).collect()
    assert [(r.md_column, r.q1, r.q3) for r in b] == [("MarkDown1", 1.75, 4.75)]
    assert b[0].upper_fence == 4.75 + 3 * 3.0


def test_zero_and_negative_samples(spark):
    rows = series_rows(sales=[0.0, -5.0, 3.0, -9.0, 0.0], md1=[None] * 5)
    df = spark.createDataFrame(rows, CLEAN_DDL)
    assert insp.sales_sign_counts(df).first().asDict() == {"zero_count": 2, "negative_count": 2}
    assert [r.Weekly_Sales for r in insp.negative_sales(df).collect()] == [-9.0, -5.0]
    assert [r.Date for r in insp.zero_sales(df).collect()] == [d("2010-01-01"), d("2010-01-29")]


def test_null_profile_lists_only_columns_with_nulls(spark):
    df = spark.createDataFrame(series_rows(), CLEAN_DDL)
    got = {r.column_name: (r.null_count, r.null_pct) for r in prof.null_profile(df).collect()}
    assert set(got) == {"MarkDown1", "MarkDown2", "MarkDown3", "MarkDown4", "MarkDown5"}
    assert got["MarkDown1"] == (6, 50.0) and got["MarkDown2"] == (12, 100.0)


def test_profile_summary_and_trend(spark):
    df = spark.createDataFrame(series_rows() + series_rows(dept=2), CLEAN_DDL)
    p = prof.profile_summary(df).first()
    assert (p.row_count, p.column_count, p.store_count, p.dept_count) == (24, 16, 1, 2)
    t = insight.trend_ends(df).first()
    assert t.first_month == "2010-01" and t.last_month == "2010-03"
    e = insight.markdown_effect(df).first()
    assert e.mean_with_markdown == sum(100.0 + 10 * i for i in range(6, 12)) / 6
    assert prof.dtypes(df)[0] == ("Store", "int")


def test_approx_distinct_option(spark):
    df = spark.createDataFrame(series_rows() + series_rows(store=2, dept=3), CLEAN_DDL)
    assert prof.profile_summary(df, approx=True).first().store_count == 2
    assert insight.kpis(df, approx=True).first().departments == 2


def test_findings_without_optional_columns(spark):
    df = spark.createDataFrame([(1, 1, d("2010-01-01"), 5.0), (1, 1, d("2010-01-08"), -2.0)],
                               "Store int, Dept int, Date date, Weekly_Sales double")
    assert insp.holiday_spikes(df).count() == 0
    assert insight.holiday_impact(df).first().holiday_mean is None
    assert insp.markdown_iqr_bounds(df).count() == 0
    assert insp.markdown_outliers(df).count() == 0
    assert insp.rows_above_fence(df).first().rows_above_fence == 0
    assert insight.markdown_corr(df).count() == 0
    assert prof.profile_summary(df).first().row_count == 2
    assert insp.sales_sign_counts(df).first().negative_count == 1
    assert insp.wow_anomalies(df).count() == 1
