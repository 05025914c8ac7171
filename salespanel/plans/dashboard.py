"""The two dashboard pages' data, as tables computed from a run folder.

``descriptive`` is what the descriptive page shows for a run that passed the
gate (KPIs, monthly trend, correlation matrix, business-intelligence
findings); ``predictive`` is what the predictive page shows for a completed
run (candidate comparison, selected metrics, forecast per date). Rendering
is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespanel.operators import insight
from salespanel.operators import inspect as insp
from salespanel.plans.pipeline import forecast
from salespanel.plans.runs import DESCRIPTIVE_STATUSES, PREDICTIVE_STATUSES, list_runs, runs_with_status
from salespanel.sources.raw import read_clean


def eligible_runs(spark: SparkSession, root: str, page: str) -> DataFrame:
    """Runs a page may show: passed the gate (descriptive) or completed
    (predictive), newest first."""
    statuses = DESCRIPTIVE_STATUSES if page == "descriptive" else PREDICTIVE_STATUSES
    return runs_with_status(list_runs(spark, root), statuses)


def descriptive(spark: SparkSession, run_dir: str) -> dict[str, DataFrame]:
    """KPIs, unrounded monthly trend, correlation matrix and the BI findings,
    recomputed from the run's clean table (as the page does)."""
    clean = read_clean(spark, f"{run_dir}/clean_data")
    bounds = insp.markdown_iqr_bounds(clean)
    return {
        "kpis": insight.kpis(clean),
        "monthly_trend": insight.monthly_trend(clean),
        "markdown_corr": insight.markdown_corr(clean),
        "holiday_impact": insight.holiday_impact(clean),
        "top_spike_stores": insp.holiday_spikes(clean, 5),
        "markdown_effect": insight.markdown_effect(clean, insp.markdown_outliers(clean, bounds),
                                                   insp.rows_above_fence(clean, bounds)),
    }


#: Decimals of each finding in the printed report (fixed values).
REPORT_DIGITS = {
    "holiday_spikes": {"spike_ratio": 3},
    "wow_anomalies": {"pct_change": 3},
    "monthly_trend": {"mean_sales": 2},
    "holiday_impact": {"holiday_mean": 2, "non_holiday_mean": 2},
    "markdown_effect": {"mean_with_markdown": 2, "mean_without_markdown": 2},
}


def report_form(df: DataFrame, finding: str) -> DataFrame:
    """A finding as the printed report gives it: rounded in the last select,
    after all ranking and comparing."""
    digits = REPORT_DIGITS.get(finding, {})
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def predictive(spark: SparkSession, run_dir: str) -> dict[str, DataFrame]:
    """Candidate comparison, the selected model's metrics and the hold-out
    forecast per date (long form) of a completed run."""
    comparison = spark.read.parquet(f"{run_dir}/model_comparison")
    return {
        "model_comparison": comparison,
        "selected": comparison.filter(F.col("selected")).drop("selected"),
        "forecast_by_date": forecast(spark, run_dir),
    }
