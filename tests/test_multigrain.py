"""Findings from the grouping sets and the one scan equal those computed one by one."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from salespanel.operators import insight, multigrain
from salespanel.operators import inspect as insp
from salespanel.operators import profile as prof
from tests.conftest import CLEAN_DDL, d


@pytest.fixture(scope="module")
def clean(spark):
    r = random.Random(6)
    rows = []
    for store in range(1, 13):
        for dept in range(1, 5):
            for month in range(1, 13):
                md = [None if r.random() < 0.5 else round(r.choice([1, 1, 1, 500]) * r.random() * 100, 2) for _ in range(5)]
                md[4] = None
                sales = r.choice([0.0, round(r.uniform(-50, 900), 2), float(month)])
                rows.append((store, dept, d(f"2010-{month:02d}-05"), sales, store > 2 and month in (2, 11), "A", 10, 1.0, 2.0, *md, 3.0, 4.0))
    return spark.createDataFrame(rows, CLEAN_DDL).repartition(6)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_grains_give_the_same_findings(clean):
    g = multigrain.grains(clean).persist()
    md = insight.markdown_columns(clean)
    assert rows(multigrain.dept_top10(g)) == rows(prof.dept_top10(clean))
    assert rows(multigrain.monthly_trend(g)) == rows(insight.monthly_trend(clean))
    assert rows(multigrain.holiday_spikes(g)) == rows(insp.holiday_spikes(clean)) != []
    for n in (g.count(), 10 ** 9):  # walked at once, or narrowed first
        assert sorted(rows(multigrain.markdown_iqr_bounds(g, n, md))) == sorted(rows(insp.markdown_iqr_bounds(clean)))
    g.unpersist()


def test_samples_give_the_same_lists(spark, clean, tmp_path):
    md, bounds, seen = insight.markdown_columns(clean), insp.markdown_iqr_bounds(clean).persist(), Observation("above")
    multigrain.samples(clean, bounds, seen).write.parquet(f"{tmp_path}/s")
    s = spark.read.parquet(f"{tmp_path}/s")
    assert rows(multigrain.sales_sample(s, multigrain.ZERO)) == rows(insp.zero_sales(clean)) != []
    assert rows(multigrain.sales_sample(s, multigrain.NEGATIVE)) == rows(insp.negative_sales(clean)) != []
    assert rows(multigrain.markdown_outliers(s, md)) == rows(insp.markdown_outliers(clean, bounds)) != []
    assert seen.get["rows_above_fence"] == insp.rows_above_fence(clean, bounds).first()[0] > 0
    assert s.count() <= 15 * (2 + len(md))


def test_grains_read_the_table_once(clean):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(multigrain.grains(clean)).count("LogicalRDD") == 1


def test_absent_optional_columns(clean):
    few = clean.select("Store", "Dept", "Date", "Weekly_Sales")
    g = multigrain.grains(few)
    assert rows(multigrain.dept_top10(g)) == rows(prof.dept_top10(few))
    s = multigrain.samples(few, few.select(F.lit("").alias("md_column"), F.lit(0.0).alias("upper_fence")))
    assert rows(multigrain.sales_sample(s, multigrain.ZERO)) == rows(insp.zero_sales(few))
