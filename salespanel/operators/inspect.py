"""Micro-inspection: record-level findings tied to (Store, Dept, Date) rows.

Top-k findings use either a global ``orderBy().limit()`` (planned as a
distributed take-ordered: every task keeps its own k rows) or a
``row_number() <= k`` filter per group, which Spark plans with a partial
window-group limit before the exchange, so a hot group never ships more than
k rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespanel.functions.scalar import exact_mean, pct_change
from salespanel.operators.insight import markdown_columns
from salespanel.operators.onerow import OneRow, run
from salespanel.operators.quantiles import exact_quantiles
from salespanel.schemas import (
    ANOMALY_TOP_N,
    HOLIDAY_SPIKE_TOP_N,
    IQR_FENCE_MULTIPLIER,
    MICRO_INSPECTION_SAMPLE_SIZE,
    OUTLIERS_PER_COLUMN,
    SERIES_KEYS,
    TARGET,
)

SAMPLE_COLUMNS = ("Store", "Dept", "Date", TARGET)


def sales_sign_counts_spec(df: DataFrame, prefix: str = "sc_") -> OneRow:
    aggs = [F.count_if(F.col(TARGET) == 0).alias(f"{prefix}zero_count"),
            F.count_if(F.col(TARGET) < 0).alias(f"{prefix}negative_count")]

    def finish(w: DataFrame) -> DataFrame:
        return w.select(F.col(f"{prefix}zero_count").alias("zero_count"),
                        F.col(f"{prefix}negative_count").alias("negative_count"))
    return OneRow(aggs, finish)


def sales_sign_counts(df: DataFrame) -> DataFrame:
    """Number of zero-sales and negative-sales rows (one pass)."""
    return run(df, sales_sign_counts_spec(df))


def zero_sales(df: DataFrame, n: int = MICRO_INSPECTION_SAMPLE_SIZE) -> DataFrame:
    """First ``n`` zero-sales rows in (Store, Dept, Date) order."""
    return (df.filter(F.col(TARGET) == 0).select(*SAMPLE_COLUMNS)
              .orderBy("Store", "Dept", "Date").limit(n))


def negative_sales(df: DataFrame, n: int = MICRO_INSPECTION_SAMPLE_SIZE) -> DataFrame:
    """The ``n`` most negative sales rows (ties by Store, Dept, Date)."""
    return (df.filter(F.col(TARGET) < 0).select(*SAMPLE_COLUMNS)
              .orderBy(TARGET, "Store", "Dept", "Date").limit(n))


def holiday_means(df: DataFrame) -> DataFrame:
    """Per store: mean sales of holiday and of non-holiday weeks. One
    grouped aggregation with conditional means (no pivot job)."""
    return df.groupBy("Store").agg(
        exact_mean(F.when(F.col("IsHoliday"), F.col(TARGET))).alias("holiday_mean"),
        exact_mean(F.when(~F.col("IsHoliday"), F.col(TARGET))).alias("non_holiday_mean"))


def holiday_spikes(df: DataFrame, n: int = HOLIDAY_SPIKE_TOP_N) -> DataFrame:
    """Stores with the largest holiday / non-holiday mean ratio. Stores
    lacking either kind of week, or with a zero non-holiday mean, are left
    out; without an IsHoliday column there are none."""
    if "IsHoliday" not in df.columns:
        return df.sparkSession.createDataFrame(
            [], f"Store {dict(df.dtypes)['Store']}, holiday_mean double, non_holiday_mean double, spike_ratio double")
    return ranked_spikes(holiday_means(df), n)


def ranked_spikes(means: DataFrame, n: int) -> DataFrame:
    """The largest ratios of (Store, holiday_mean, non_holiday_mean)."""
    m = means.dropna(subset=["holiday_mean", "non_holiday_mean"])
    ratio = F.col("holiday_mean") / F.nullif(F.col("non_holiday_mean"), F.lit(0.0))
    return (m.withColumn("spike_ratio", ratio).dropna(subset=["spike_ratio"])
             .orderBy(F.desc("spike_ratio"), F.asc("Store")).limit(n))


def markdown_iqr_bounds(df: DataFrame, digits: int | None = None, approx: bool = False) -> DataFrame:
    """Per markdown column: exact quartiles (linear interpolation, nulls
    skipped), the IQR and the upper fence q3 + 3 * IQR. Columns with no
    values are left out. ``digits`` rounds the figures for display; bounds
    that rows are compared with stay as they are.

    The columns are stacked to (md_column, value) and the quartiles come
    from ``exact_quantiles``: no task ever holds all values of a column.
    ``approx=True`` uses ``percentile_approx`` instead (bounded sketch, one
    pass, not exact)."""
    md = markdown_columns(df)
    if not md:
        return df.sparkSession.createDataFrame([], "md_column string, q1 double, q3 double, iqr double, upper_fence double")
    stacked = (df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("md_column"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(md)])).alias("s")).select("s.*"))
    if approx:
        q = (stacked.groupBy("col_idx", "md_column")
                    .agg(F.percentile_approx("value", [0.25, 0.75], 100000).alias("q"))
                    .select("md_column", F.col("q").getItem(0).alias("q1"), F.col("q").getItem(1).alias("q3")))
    else:
        q = exact_quantiles(stacked, "value", [0.25, 0.75], ["q1", "q3"], groups=["md_column"])
    return iqr_of_quartiles(q, digits)


def iqr_of_quartiles(q: DataFrame, digits: int | None = None) -> DataFrame:
    """The bounds from (md_column, q1, q3), without columns that have no values."""
    q1, q3 = F.col("q1"), F.col("q3")
    iqr = q3 - q1
    shown = {"q1": q1, "q3": q3, "iqr": iqr, "upper_fence": q3 + IQR_FENCE_MULTIPLIER * iqr}
    return (q.filter(q1.isNotNull())
             .select("md_column", *[(c if digits is None else F.round(c, digits)).alias(name)
                                    for name, c in shown.items()]))


def fences(bounds: DataFrame, md: list[str]) -> Column:
    """The upper fences as ONE scalar subquery returning a struct with a
    field per markdown column (null for a column without values)."""
    return bounds.agg(F.struct(*[F.max(F.when(F.col("md_column") == c, F.col("upper_fence"))).alias(c)
                                 for c in md])).scalar()


def markdown_outliers(df: DataFrame, bounds: DataFrame | None = None,
                      per_column: int = OUTLIERS_PER_COLUMN, cap: int = ANOMALY_TOP_N) -> DataFrame:
    """Extreme markdown rows: per markdown column the ``per_column`` largest
    values above the column's fence, in column order 1..5, then cut to
    ``cap`` rows overall (so later columns may not appear at all).

    Plan: the fences are one scalar subquery (a struct of five values,
    computed once); rows are filtered on the wide form before the unpivot,
    so only candidate rows are reshaped; the
    per-column top-k is a ``row_number <= k`` filter that Spark evaluates as a
    partial group limit ahead of the shuffle."""
    md = markdown_columns(df)
    if not md:
        return df.sparkSession.createDataFrame(
            [], "md_column string, Store int, Dept int, Date date, value double, upper_bound double, "
                "rank_in_column int")
    if bounds is None:
        bounds = markdown_iqr_bounds(df)
    fence = fences(bounds, md)
    any_above = F.lit(False)
    for c in md:
        any_above = any_above | (F.col(c) > fence[c])
    cand = df.select("Store", "Dept", "Date", *md).filter(any_above)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("md_column"), F.col(c).alias("value"),
                 fence[c].alias("fence"))
        for i, c in enumerate(md)]))
    long = (cand.select("Store", "Dept", "Date", stacked.alias("m"))
                .select("Store", "Dept", "Date", "m.*")
                .filter(F.col("value") > F.col("fence")))
    w = Window.partitionBy("col_idx").orderBy(F.desc("value"), "Store", "Dept", "Date")
    top = long.withColumn("rank_in_column", F.row_number().over(w)).filter(F.col("rank_in_column") <= per_column)
    return (top.orderBy("col_idx", "rank_in_column").limit(cap)
               .select("md_column", "Store", "Dept", "Date", "value",
                       F.round("fence", 2).alias("upper_bound"), "rank_in_column"))


def rows_above_fence(df: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """One row: how many rows exceed the fence of at least one markdown column
    (the true count behind the capped outlier list)."""
    md = markdown_columns(df)
    if not md:
        return df.agg(F.lit(0).cast("long").alias("rows_above_fence"))
    if bounds is None:
        bounds = markdown_iqr_bounds(df)
    fence = fences(bounds, md)
    above = F.lit(False)
    for c in md:
        above = above | (F.col(c) > fence[c])
    return df.agg(F.count_if(above).alias("rows_above_fence"))


def with_prev_sales(df: DataFrame) -> DataFrame:
    """Adds prev_sales (the previous row of the same Store/Dept series by
    Date) and the week-over-week change. Rows, not calendar weeks: a missing
    week is not skipped over."""
    w = Window.partitionBy(*SERIES_KEYS).orderBy("Date")
    return (df.withColumn("prev_sales", F.lag(TARGET, 1).over(w))
              .withColumn("pct_change", pct_change(F.col(TARGET), F.col("prev_sales"))))


def prev_from_lags(lagged: DataFrame) -> DataFrame:
    """Same columns as ``with_prev_sales`` from a table that already carries
    the shared series lags (see ``features.add_lags``): no second window."""
    return (lagged.withColumn("prev_sales", F.col("__lag1"))
                  .withColumn("pct_change", pct_change(F.col(TARGET), F.col("prev_sales"))))


def wow_change(df: DataFrame) -> DataFrame:
    """Week-over-week change of every row (null where there is no previous
    row or both weeks are zero; +/-inf after a zero week)."""
    return with_prev_sales(df).select("Store", "Dept", "Date", "prev_sales", TARGET, "pct_change")


def wow_anomalies(df: DataFrame, n: int = ANOMALY_TOP_N, prepared: bool = False) -> DataFrame:
    """The ``n`` largest absolute week-over-week swings."""
    w = df if prepared else with_prev_sales(df)
    return (w.filter(F.col("pct_change").isNotNull())
             .orderBy(F.desc(F.abs("pct_change")), "Store", "Dept", "Date").limit(n)
             .select("Store", "Dept", "Date", "prev_sales", TARGET, "pct_change"))
