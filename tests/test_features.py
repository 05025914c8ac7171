"""Feature engineering (ported cases of the reference plus edge rules)."""

import datetime as dt

from pyspark.sql import functions as F

from salespanel.operators import features as feat
from tests.conftest import CLEAN_DDL, d, series_rows


def single(spark, **kw):
    return spark.createDataFrame(series_rows(**kw), CLEAN_DDL)


def test_lag_features_have_no_leakage(spark):
    df = feat.engineer_features(single(spark))
    row = df.filter(F.col("Date") == d("2010-01-01") + dt.timedelta(days=35)).first()
    assert row["Weekly_Sales_Lag1"] == 140.0
    assert row["Weekly_Sales_Lag4"] == 110.0
    assert df.filter(F.col("Weekly_Sales_Lag1") >= F.col("Weekly_Sales")).count() == 0


def test_rows_without_enough_history_are_dropped(spark):
    df = feat.engineer_features(single(spark))
    assert df.count() == 12 - 4
    for c in ("Weekly_Sales_Lag1", "Weekly_Sales_Lag4", "Weekly_Sales_RollingMean4"):
        assert df.filter(F.col(c).isNull()).count() == 0


def test_rolling_mean_and_std_values(spark):
    df = feat.engineer_features(single(spark))
    row = df.filter(F.col("Date") == d("2010-01-01") + dt.timedelta(days=28)).first()
    # previous four weeks: 100, 110, 120, 130
    assert row["Weekly_Sales_RollingMean4"] == 115.0
    assert abs(row["Weekly_Sales_RollingStd4"] - 12.909944487358056) < 1e-12


def test_markdown_imputed_to_zero(spark):
    df = feat.engineer_features(single(spark))
    assert df.filter(F.col("MarkDown2") != 0.0).count() == 0
    assert df.filter(F.col("MarkDown2").isNull()).count() == 0


def test_type_one_hot_encoded(spark):
    df = feat.engineer_features(single(spark))
    assert "Type_A" in df.columns and "Type" not in df.columns
    assert df.filter(F.col("Type_A") != 1).count() == 0
    assert df.columns[-1] == "Type_A"


def test_null_type_gives_all_zeros(spark):
    rows = series_rows(typ="A") + series_rows(store=2, typ=None)
    df = feat.encode_categoricals(spark.createDataFrame(rows, CLEAN_DDL))
    z = df.filter(F.col("Store") == 2).select("Type_A").distinct().collect()
    assert [r[0] for r in z] == [0]


def test_feature_columns_exclude_identifiers_and_target(spark):
    df = feat.engineer_features(single(spark))
    cols = feat.feature_columns(df)
    for c in ("Store", "Dept", "Date", "Weekly_Sales"):
        assert c not in cols
    assert "Weekly_Sales_Lag1" in cols and len(cols) == 18 - 2  # one store type only


def test_lags_count_rows_not_weeks(spark):
    dates = [d("2010-01-04") + dt.timedelta(days=7 * i) for i in (0, 1, 3, 4, 5)]
    df = spark.createDataFrame(series_rows(sales=[1.0, 2.0, 4.0, 5.0, 6.0], dates=dates,
                                           md1=[None] * 5), CLEAN_DDL)
    out = feat.lag_columns(feat.add_lags(df)).filter(F.col("Date") == dates[2]).first()
    assert out["Weekly_Sales_Lag1"] == 2.0


def test_null_inside_window_gives_null_rolling(spark):
    sales = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame(series_rows(sales=sales, md1=[None] * 8), CLEAN_DDL)
    out = feat.drop_private(feat.rolling_columns(feat.add_lags(df))).orderBy("Date").collect()
    assert out[4]["Weekly_Sales_RollingMean4"] is None   # window 1, 2, null, 4
    assert out[5]["Weekly_Sales_RollingMean4"] is None   # window 2, null, 4, 5
    assert out[6]["Weekly_Sales_RollingMean4"] is None   # window null, 4, 5, 6
    assert out[7]["Weekly_Sales_RollingMean4"] == 5.5    # window 4, 5, 6, 7


def test_economic_fill_store_then_global_median(spark):
    rows = []
    for i, cpi in enumerate([1.0, None, 3.0, 10.0]):
        rows.append((1, 1, d("2010-01-04") + dt.timedelta(days=7 * i), 1.0, False, "A", 1, 1.0, 1.0,
                     None, None, None, None, None, cpi, 5.0))
    rows.append((2, 1, d("2010-01-04"), 1.0, False, "A", 1, 1.0, 1.0, None, None, None, None, None, None, None))
    df = feat.impute_economic(spark.createDataFrame(rows, CLEAN_DDL))
    got = {(r.Store, r.Date): r.CPI for r in df.collect()}
    assert got[(1, d("2010-01-11"))] == 3.0           # store median of 1, 3, 10
    # store 2 has nothing: global median of the store-filled column 1, 3, 3, 10
    assert got[(2, d("2010-01-04"))] == 3.0
    assert {r.Unemployment for r in df.collect()} == {5.0}


def test_type_cardinality_is_bounded(spark):
    import pytest
    rows = [r[:5] + (f"T{i}",) + r[6:] for i, r in enumerate(series_rows())]
    df = spark.createDataFrame(rows, CLEAN_DDL)
    assert len(feat.observed_types(df)) == 12
    with pytest.raises(ValueError, match="distinct values"):
        feat.observed_types(df, max_categories=5)


def test_approximate_economic_fill(spark):
    rows = []
    for i, cpi in enumerate([1.0, None, 3.0, 10.0, 4.0]):
        rows.append((1, 1, d("2010-01-04") + dt.timedelta(days=7 * i), 1.0, False, "A", 1, 1.0, 1.0,
                     None, None, None, None, None, cpi, 5.0))
    rows.append((2, 1, d("2010-01-04"), 1.0, False, "A", 1, 1.0, 1.0, None, None, None, None, None, None, None))
    df = spark.createDataFrame(rows, CLEAN_DDL)
    got = {(r.Store, r.Date): r.CPI for r in feat.impute_economic(df, approx=True).collect()}
    assert got[(1, d("2010-01-11"))] in (3.0, 4.0)         # a middle value of 1, 3, 4, 10
    assert got[(2, d("2010-01-04"))] is not None
    assert all(v is not None for v in got.values())
