"""The clean table by series: no exchange for windows and key checks, the same results."""

import os

import pytest

from salespanel.operators import contract as con
from salespanel.operators import features as feat
from salespanel.operators import inspect as insp
from salespanel.sources.raw import read_clean, write_series
from tests.conftest import CLEAN_DDL, series_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rows = [r for s in range(1, 7) for d in range(1, 9) for r in series_rows(store=s, dept=d, sales=[s * 7.5 + d * k % 11 for k in range(20)])]
    df = spark.createDataFrame(rows + rows[:3], CLEAN_DDL).repartition(5)
    path = str(tmp_path_factory.mktemp("series") / "clean")
    return df, write_series(df, path), path


@pytest.mark.parametrize("make", [
    lambda c: feat.drop_private(feat.rolling_columns(feat.lag_columns(feat.add_lags(c)))), insp.wow_change,
    lambda c: c.groupBy("Store", "Dept", "Date").count()], ids=["lags", "week_over_week", "keys"])
def test_no_exchange_and_the_same_rows(both, make):
    df, table, _ = both
    assert "Exchange" not in plan(make(table)) and "Exchange" in plan(make(df))
    key = lambda r: (r.Store, r.Dept, r.Date, str(r))
    if make is not insp.wow_change and "count" in make(df).columns:
        assert sorted(make(table).collect(), key=key) == sorted(make(df).collect(), key=key)
    else:  # repeated keys have no order among themselves
        whole = lambda d: d.filter("NOT (Store = 1 AND Dept = 1)")
        assert sorted(whole(make(table)).collect(), key=key) == sorted(whole(make(df)).collect(), key=key)


def test_key_check_only_adds_up_one_row_a_task(both):
    df, table, _ = both
    assert con.pk_duplicates(table).first()[0] == con.pk_duplicates(df).first()[0] == 3
    assert "hashpartitioning" not in plan(con.pk_duplicates(table)) and plan(con.pk_duplicates(table)).count("Exchange ") == 1


def test_the_files_are_plain_parquet_in_order(spark, both):
    df, table, path = both
    assert read_clean(spark, path).count() == df.count() and table.columns == df.columns
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    for f in files:
        rows = spark.read.parquet(f"{path}/{f}").select("Store", "Dept", "Date").collect()
        assert rows == sorted(rows)
