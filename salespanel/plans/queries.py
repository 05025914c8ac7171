"""Registry of the engine's queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables through the derived panel, so its work
grows with them."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespanel.functions.scalar import coerce_bool, parse_date, typed
from salespanel.operators import contract as con
from salespanel.operators import features as feat
from salespanel.operators import ingest as ing
from salespanel.operators import insight
from salespanel.operators import inspect as insp
from salespanel.operators import model as mdl
from salespanel.operators import profile as prof
from salespanel.plans.panel import materialize_sources, read_sources, table
from salespanel.schemas import ENGINEERED_COLUMNS, MARKDOWN_COLUMNS, TARGET
from salespanel.session import app_id, shared_dir
from salespanel.sources.raw import read_clean, write_clean, write_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def reg(fn):
        QUERIES[name] = fn
        return fn
    return reg


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the folder's tables as they are now (names, lengths, times),
    so that rewritten data is never answered from what was kept before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seen = [sf_dir]
    for top in fs.listStatus(path):
        for f in (fs.listStatus(top.getPath()) if top.isDirectory() else [top]):
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:12]


_SOURCES: dict = {}
# one lock for the write-once caches below (a concurrent caller waits for
# the first writer instead of writing the same folder twice)
_LOCK = threading.RLock()


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The {stores, features, train} sources derived from the driver tables
    in ``sf_dir``: derived once per application and written to the shared
    folder (the ingest stage of a run), then read by every query."""
    app = app_id(spark)
    key = (app, digest := _state(spark, sf_dir))
    with _LOCK:
        if key not in _SOURCES:
            path = f"{shared_dir(spark)}/salespanel-sources/{app}/{digest}"
            materialize_sources(spark, sf_dir, path)
            _SOURCES[key] = path
    return read_sources(spark, _SOURCES[key])


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel (no eager key check; see ``join_key_check``)."""
    return ing.ingest(raw_tables(spark, sf_dir), check_keys=False)


_SERIES: dict = {}


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel as a run stores it: written once per application, whole
    series in buckets. Queries over series start from it."""
    app = app_id(spark)
    key = (app, digest := _state(spark, sf_dir))
    with _LOCK:
        if key not in _SERIES:
            path = f"{shared_dir(spark)}/salespanel-series/{app}/{digest}"
            _SERIES[key] = write_series(clean(spark, sf_dir), path)
    return _SERIES[key]


@query("monthly_trend")
def q_monthly_trend(spark, sf):
    return insight.monthly_trend(clean(spark, sf))


# ---- profiling -------------------------------------------------------------


@query("profile_summary")
def q_profile_summary(spark, sf):
    return prof.profile_summary(clean(spark, sf))


@query("null_profile")
def q_null_profile(spark, sf):
    return prof.null_profile(clean(spark, sf))


@query("dept_top10")
def q_dept_top10(spark, sf):
    return prof.dept_top10(clean(spark, sf))


# ---- micro-inspection ------------------------------------------------------
@query("sales_sign_counts")
def q_sales_sign_counts(spark, sf):
    return insp.sales_sign_counts(clean(spark, sf))


@query("zero_sales")
def q_zero_sales(spark, sf):
    return insp.zero_sales(clean(spark, sf))


@query("negative_sales")
def q_negative_sales(spark, sf):
    return insp.negative_sales(clean(spark, sf))


@query("holiday_spikes")
def q_holiday_spikes(spark, sf):
    return insp.holiday_spikes(clean(spark, sf))


@query("markdown_iqr_bounds")
def q_markdown_iqr_bounds(spark, sf):
    return insp.markdown_iqr_bounds(clean(spark, sf), digits=6)


@query("markdown_outliers")
def q_markdown_outliers(spark, sf):
    return insp.markdown_outliers(clean(spark, sf))


@query("wow_change")
def q_wow_change(spark, sf):
    return insp.wow_change(series(spark, sf))


@query("wow_anomalies")
def q_wow_anomalies(spark, sf):
    return insp.wow_anomalies(series(spark, sf))


# ---- business intelligence / dashboard --------------------------------------
@query("trend_ends")
def q_trend_ends(spark, sf):
    return insight.trend_ends(clean(spark, sf))


@query("holiday_impact")
def q_holiday_impact(spark, sf):
    return insight.holiday_impact(clean(spark, sf))


@query("kpis")
def q_kpis(spark, sf):
    return insight.kpis(clean(spark, sf))


@query("markdown_effect")
def q_markdown_effect(spark, sf):
    c = clean(spark, sf)
    bounds = insp.markdown_iqr_bounds(c)
    return insight.markdown_effect(c, insp.markdown_outliers(c, bounds), insp.rows_above_fence(c, bounds))


@query("markdown_corr")
def q_markdown_corr(spark, sf):
    return insight.markdown_corr(clean(spark, sf))


# ---- features --------------------------------------------------------------


@query("lag_features")
def q_lag_features(spark, sf):
    df = feat.drop_private(feat.lag_columns(feat.add_lags(series(spark, sf))))
    return df.select("Store", "Dept", "Date", TARGET, f"{TARGET}_Lag1", f"{TARGET}_Lag4")


@query("rolling_features")
def q_rolling_features(spark, sf):
    df = feat.drop_private(feat.rolling_columns(feat.add_lags(series(spark, sf))))
    return df.select("Store", "Dept", "Date", *ENGINEERED_COLUMNS[2:])


@query("impute_markdowns")
def q_impute_markdowns(spark, sf):
    return feat.impute_markdowns(clean(spark, sf)).select("Store", "Dept", "Date", *MARKDOWN_COLUMNS)


@query("store_medians")
def q_store_medians(spark, sf):
    return feat.store_medians(clean(spark, sf))


@query("impute_economic")
def q_impute_economic(spark, sf):
    return feat.impute_economic(clean(spark, sf)).select("Store", "Dept", "Date", "CPI", "Unemployment")


@query("encode_features")
def q_encode_features(spark, sf):
    df = feat.encode_categoricals(clean(spark, sf))
    return df.select("Store", "Dept", "Date", "IsHoliday", *[c for c in df.columns if c.startswith("Type_")])


@query("feature_table")
def q_feature_table(spark, sf):
    return feat.engineer_features(series(spark, sf))


# ---- contract --------------------------------------------------------------


@query("contract_bounds")
def q_contract_bounds(spark, sf):
    return con.contract_bounds(clean(spark, sf))


@query("contract_check")
def q_contract_check(spark, sf):
    c = series(spark, sf)
    return con.contract_checks(c, con.build_contract(c))


@query("contract_verdict")
def q_contract_verdict(spark, sf):
    c = series(spark, sf)
    return con.contract_verdict(con.contract_checks(c, con.build_contract(c)))


@query("pk_duplicates")
def q_pk_duplicates(spark, sf):
    return con.pk_duplicates(series(spark, sf))


# ---- split, metrics, models ------------------------------------------------


def feature_table(spark, sf):
    return feat.engineer_features(series(spark, sf))


_FEATURES: dict = {}


def written_features(spark, sf):
    """The feature table written once per application to the shared folder
    (the scientist stage reads it, as a run does); split, metric and model
    queries start from it."""
    app = app_id(spark)
    key = (app, digest := _state(spark, sf))
    with _LOCK:
        if key not in _FEATURES:
            path = f"{shared_dir(spark)}/salespanel-features/{app}/{digest}"
            feature_table(spark, sf).write.mode("overwrite").parquet(path)
            _FEATURES[key] = path
    return spark.read.parquet(_FEATURES[key])


def _test_rows(spark, sf):
    return mdl.label_split(written_features(spark, sf)).filter(~F.col("is_train"))


@query("chrono_cutoff")
def q_chrono_cutoff(spark, sf):
    return mdl.chrono_cutoff(written_features(spark, sf))


@query("chrono_split")
def q_chrono_split(spark, sf):
    return mdl.label_split(written_features(spark, sf)).select("Store", "Dept", "Date", "is_train")


@query("split_summary")
def q_split_summary(spark, sf):
    return mdl.split_summary(written_features(spark, sf))


@query("naive_metrics")
def q_naive_metrics(spark, sf):
    return mdl.evaluate(_test_rows(spark, sf), prediction=f"{TARGET}_Lag1", digits=6)


@query("sales_long")
def q_sales_long(spark, sf):
    return mdl.forecast_by_date(_test_rows(spark, sf), prediction=f"{TARGET}_Lag1",
                                prediction_name="Naive_Sales", exact_prediction=True)


_TRAINED: dict = {}


def trained(spark, sf):
    """Train once per (session, data dir) and reuse across the model queries."""
    key = (app_id(spark), _state(spark, sf))
    with _LOCK:
        if key not in _TRAINED:
            ft = written_features(spark, sf)
            _TRAINED[key] = (ft, mdl.train_and_select(ft, feat.feature_columns(ft)))
    return _TRAINED[key]


def _scored(spark, sf):
    """The hold-out rows as each trained candidate scores them."""
    ft, res = trained(spark, sf)
    test = mdl.split(ft, F.to_date(F.lit(res.split_cutoff_date)))[1]
    return {name: res.models[name].transform(test) for name in mdl.CANDIDATES}


def _comparison(spark, sf):
    return mdl.compare_scored(_scored(spark, sf))


def _metrics_row(spark, sf, name):
    return mdl.compare_scored({name: _scored(spark, sf)[name]}).drop("selected")


@query("ridge_metrics")
def q_ridge_metrics(spark, sf):
    return _metrics_row(spark, sf, mdl.RIDGE)


@query("forest_metrics")
def q_forest_metrics(spark, sf):
    return _metrics_row(spark, sf, mdl.FOREST)


@query("model_comparison")
def q_model_comparison(spark, sf):
    return _comparison(spark, sf)


@query("model_selection")
def q_model_selection(spark, sf):
    return (_comparison(spark, sf).filter("selected")
            .select(F.col("model").alias("selected_model_name"), "RMSE"))


@query("forecast_by_date")
def q_forecast_by_date(spark, sf):
    return mdl.forecast_by_date(_scored(spark, sf)[trained(spark, sf)[1].selected_model_name])


# ---- the ridge candidate on its own, checked against its closed form ----------


def _train_rows(spark, sf):
    return mdl.label_split(written_features(spark, sf)).filter(F.col("is_train")).drop("is_train")


@query("ridge_moments")
def q_ridge_moments(spark, sf):
    """The moment matrix; the root of the mean comoment, so that digits that
    floating sums settle in any order are shown."""
    train = _train_rows(spark, sf)
    m = mdl.ridge_moments(train, feat.feature_columns(train))
    spread = F.signum("comoment") * F.sqrt(F.abs("comoment") / F.col("n"))
    return m.select("col_a", "col_b", "n", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"),
                    F.round(spread, 3).alias("spread"))


_RIDGE: dict = {}


def _ridge_scored(spark, sf):
    """The hold-out rows as the ridge fitted to the training rows scores them (fitted once per session and data dir)."""
    key = (app_id(spark), _state(spark, sf))
    with _LOCK:
        if key not in _RIDGE:
            train = _train_rows(spark, sf)
            cols = feat.feature_columns(train)
            _RIDGE[key] = mdl.ridge_estimator(train, cols).fit(train)
    return _RIDGE[key].transform(_test_rows(spark, sf))


@query("ridge_forecast")
def q_ridge_forecast(spark, sf):
    long = mdl.forecast_by_date(_ridge_scored(spark, sf), prediction_name="Ridge_Sales")
    return long.select("Date", "Series", F.round("Sales", 3).alias("Sales"))


@query("candidate_selection")
def q_candidate_selection(spark, sf):
    """The comparison and the choice, with last week's sales as the other candidate."""
    naive = _test_rows(spark, sf).withColumn("prediction", F.col(f"{TARGET}_Lag1"))
    got = mdl.compare_scored({mdl.RIDGE: _ridge_scored(spark, sf), "LastWeek": naive})
    return got.select("model", *[F.round(c, 3 if c != "R2" else 6).alias(c) for c in ("MAE", "RMSE", "R2")], "selected")


# ---- ingest ----------------------------------------------------------------


@query("clean_panel")
def q_clean_panel(spark, sf):
    return clean(spark, sf)


_CLEAN_WRITTEN: dict = {}


@query("scan_clean")
def q_scan_clean(spark, sf):
    """The clean table as a run stores it (sorted Parquet in the shared
    folder, written once per application), scanned back."""
    app = app_id(spark)
    key = (app, digest := _state(spark, sf))
    with _LOCK:
        if key not in _CLEAN_WRITTEN:
            path = f"{shared_dir(spark)}/salespanel-clean/{app}/{digest}"
            write_clean(clean(spark, sf), path)
            _CLEAN_WRITTEN[key] = path
    return read_clean(spark, _CLEAN_WRITTEN[key])


@query("join_stores")
def q_join_stores(spark, sf):
    src = raw_tables(spark, sf)
    return ing.join_stores(src["train"], src["stores"]).select(
        "Store", "Dept", "Date", TARGET, "IsHoliday", "Type", "Size")


@query("join_features")
def q_join_features(spark, sf):
    src = raw_tables(spark, sf)
    return ing.join_features(src["train"], src["features"]).select(
        "Store", "Dept", "Date", TARGET, "IsHoliday", "Temperature", "Fuel_Price",
        *MARKDOWN_COLUMNS, "CPI", "Unemployment")


@query("join_key_check")
def q_join_key_check(spark, sf):
    src = raw_tables(spark, sf)
    return ing.join_key_violations(src["stores"], src["features"])


@query("drop_null_keys")
def q_drop_null_keys(spark, sf):
    src = raw_tables(spark, sf)
    merged = ing.join_features(ing.join_stores(src["train"], src["stores"]), src["features"])
    return _dropped(merged)


def _dropped(df):
    """Rows before and after the null-key drop, as the ingest applies it."""
    kept = ing.drop_null_keys(ing.normalize_nan(df)).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (df.agg(F.count(F.lit(1)).alias("rows_in"))
              .select("rows_in", kept.alias("rows_out"), (F.col("rows_in") - kept).alias("rows_dropped")))


@query("parse_dates")
def q_parse_dates(spark, sf):
    t = raw_tables(spark, sf)["train"]
    text = F.date_format("Date", "d/M/yyyy")
    return t.select("Store", "Dept", text.alias("Date_text"), parse_date(text).alias("Date"))


@query("coerce_bool")
def q_coerce_bool(spark, sf):
    t = raw_tables(spark, sf)["train"]
    text = F.when(F.col("IsHoliday"), F.lit(" True ")).otherwise(F.lit("false"))
    return t.select("Store", "Dept", "Date", text.alias("flag_text"), coerce_bool(text).alias("IsHoliday"))


# ---- the rules on rows that break them -------------------------------------
# The panel is clean by construction, so these queries put the same operators
# on all line items: keys repeat there, and text, nulls and bounds go wrong by
# expressions over real columns.


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return li.select(
        F.col("l_suppkey").alias("Store"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("Dept"),
        day.alias("Date"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice"))
         .when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias(TARGET),
        F.when(F.col("l_returnflag") == "A", F.lit(" TRUE ")).when(F.col("l_returnflag") == "N", F.lit("false"))
         .otherwise(F.lit("yes")).alias("flag_text"),
        F.when(F.col("l_linenumber") % 4 == 1, F.date_format(day, "dd/MM/yyyy"))
         .when(F.col("l_linenumber") % 4 == 2, F.date_format(day, "yyyy-MM-dd"))
         .when(F.col("l_linenumber") % 4 == 3, F.concat(F.lit("31/02/"), F.date_format(day, "yyyy")))
         .otherwise(F.date_format(day, "d/M/yyyy")).alias("date_text"),
        F.concat(F.col("l_linenumber").cast("string"),
                 F.when(F.col("l_linenumber") == 1, F.lit("d")).when(F.col("l_linenumber") == 2, F.lit(".5"))
                  .when(F.col("l_linenumber") == 3, F.lit(".0")).otherwise(F.lit(""))).alias("number_text"))


LINE_CONTRACT = {
    "primary_keys": ["Store", "Dept", "Date"],
    "target_column": TARGET,
    "columns": {
        "Store": {"dtype": "int", "nullable": False},
        "Dept": {"dtype": "int", "nullable": False},
        "Date": {"dtype": "datetime", "nullable": False},
        TARGET: {"dtype": "float", "nullable": False, "min": -5000.0, "max": 50000.0},
        "number_text": {"dtype": "int", "nullable": True},
        "flag_text": {"dtype": "colour", "nullable": True},
        "Size": {"dtype": "int", "nullable": False},
    },
}


@query("contract_check_lines")
def q_contract_check_lines(spark, sf):
    return con.contract_checks(ing.normalize_nan(_lines(spark, sf)), LINE_CONTRACT)


@query("contract_verdict_lines")
def q_contract_verdict_lines(spark, sf):
    return con.contract_verdict(q_contract_check_lines(spark, sf))


@query("pk_duplicates_lines")
def q_pk_duplicates_lines(spark, sf):
    return con.pk_duplicates(_lines(spark, sf))


@query("join_key_check_lines")
def q_join_key_check_lines(spark, sf):
    lines = _lines(spark, sf)
    return ing.join_key_violations(lines.select("Store"), lines.select("Store", "Date"))


@query("drop_null_keys_lines")
def q_drop_null_keys_lines(spark, sf):
    return _dropped(_lines(spark, sf))


@query("parse_dates_mixed")
def q_parse_dates_mixed(spark, sf):
    parsed = parse_date("date_text")
    return (_lines(spark, sf).groupBy("date_text").agg(F.count(F.lit(1)).alias("n"))
            .select("date_text", "n", parsed.alias("parsed")))


@query("coerce_bool_mixed")
def q_coerce_bool_mixed(spark, sf):
    return (_lines(spark, sf).groupBy("Store", "flag_text").agg(F.count(F.lit(1)).alias("n"))
            .select("Store", "flag_text", "n", coerce_bool("flag_text").alias("flag"),
                    coerce_bool("flag_text", "true").alias("flag_unknown_true")))


@query("numbers_mixed")
def q_numbers_mixed(spark, sf):
    return (_lines(spark, sf).groupBy("Store", "number_text").agg(F.count(F.lit(1)).alias("n"))
            .select("Store", "number_text", "n", typed("number_text", "bigint").alias("whole"),
                    typed("number_text", "double").alias("number")))


ABSENT_CONTRACT = {
    "primary_keys": ["Store", "Branch"],
    "target_column": "Revenue",
    "columns": {
        "Store": {"dtype": "int", "nullable": False},
        "Branch": {"dtype": "int", "nullable": False},
        "Revenue": {"dtype": "float", "nullable": False, "min": 0.0},
        "date_text": {"dtype": "datetime", "nullable": True},
    },
}


@query("contract_check_absent")
def q_contract_check_absent(spark, sf):
    """A key column and the target that the table doesn't have."""
    return con.contract_checks(_lines(spark, sf), ABSENT_CONTRACT)


@query("zero_sales_lines")
def q_zero_sales_lines(spark, sf):
    """The first rows without sales, where an undiscounted line counts as none."""
    li = table(spark, sf, "lineitem")
    sales = F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_extendedprice"))
    return insp.zero_sales(li.select(F.col("l_suppkey").alias("Store"), F.col("l_linenumber").alias("Dept"),
                                     F.col("l_shipdate").cast("date").alias("Date"), sales.alias(TARGET)))
