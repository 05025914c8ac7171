"""Business-intelligence summaries and dashboard aggregates of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.functions.scalar import any_not_null, exact_mean, exact_sum, pearson
from salespanel.operators.moments import by_groups, in_groups
from salespanel.operators.onerow import OneRow, run
from salespanel.schemas import TARGET


def markdown_columns(df: DataFrame) -> list[str]:
    """Columns whose name starts with ``MarkDown``, in table order."""
    return [c for c in df.columns if c.startswith("MarkDown")]


def _monthly_means(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.date_format("Date", "yyyy-MM").alias("Month"))
              .agg(exact_mean(TARGET).alias("mean_sales")))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Mean weekly sales per calendar month ('yyyy-MM'), chronological.

    One partial + final aggregation; the output has one row per month."""
    return _monthly_means(df).orderBy("Month")


def trend_ends(df: DataFrame) -> DataFrame:
    """First and last month of the trend with their means (one row)."""
    t = _monthly_means(df)
    return t.agg(F.min("Month").alias("first_month"),
                 F.min_by("mean_sales", "Month").alias("first_mean"),
                 F.max("Month").alias("last_month"),
                 F.max_by("mean_sales", "Month").alias("last_mean"))


def _pick(prefix: str, names):
    def finish(w: DataFrame) -> DataFrame:
        return w.select(*[F.col(f"{prefix}{n}").alias(n) for n in names])
    return finish


def holiday_impact_spec(df: DataFrame, prefix: str = "hi_") -> OneRow:
    if "IsHoliday" not in df.columns:     # no flag: both means are unknown
        aggs = [F.lit(None).cast("double").alias(f"{prefix}holiday_mean"),
                F.lit(None).cast("double").alias(f"{prefix}non_holiday_mean")]
        return OneRow(aggs, _pick(prefix, ["holiday_mean", "non_holiday_mean"]))
    aggs = [exact_mean(F.when(F.col("IsHoliday"), F.col(TARGET))).alias(f"{prefix}holiday_mean"),
            exact_mean(F.when(~F.col("IsHoliday"), F.col(TARGET))).alias(f"{prefix}non_holiday_mean")]
    return OneRow(aggs, _pick(prefix, ["holiday_mean", "non_holiday_mean"]))


def holiday_impact(df: DataFrame) -> DataFrame:
    """Mean sales of holiday and non-holiday weeks (one row; null if a side
    has no rows)."""
    return run(df, holiday_impact_spec(df))


def kpis_spec(df: DataFrame, prefix: str = "kp_", approx: bool = False) -> OneRow:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    aggs = [exact_sum(TARGET).alias(f"{prefix}total_sales"),
            exact_mean(TARGET).alias(f"{prefix}mean_sales"),
            distinct("Store").alias(f"{prefix}stores"),
            distinct("Dept").alias(f"{prefix}departments")]
    return OneRow(aggs, _pick(prefix, ["total_sales", "mean_sales", "stores", "departments"]))


def kpis(df: DataFrame, approx: bool = False) -> DataFrame:
    """Dashboard KPIs: total and mean sales, distinct stores and departments
    (``approx=True``: HyperLogLog estimates)."""
    return run(df, kpis_spec(df, approx=approx))


def markdown_effect_spec(df: DataFrame, outliers: DataFrame | None = None,
                         above_fence: DataFrame | None = None, prefix: str = "me_") -> OneRow:
    md = markdown_columns(df)
    flag = any_not_null(md) if md else F.lit(False)
    aggs = [exact_mean(F.when(flag, F.col(TARGET))).alias(f"{prefix}mean_with_markdown"),
            exact_mean(F.when(~flag, F.col(TARGET))).alias(f"{prefix}mean_without_markdown")]

    def finish(w: DataFrame) -> DataFrame:
        out = _pick(prefix, ["mean_with_markdown", "mean_without_markdown"])(w)
        if outliers is not None:
            out = out.withColumn("extreme_outlier_count", outliers.agg(F.count(F.lit(1))).scalar())
        if above_fence is not None:
            out = out.withColumn("rows_above_fence", above_fence.select("rows_above_fence").scalar())
        return out
    return OneRow(aggs, finish)


def markdown_effect(df: DataFrame, outliers: DataFrame | None = None,
                    above_fence: DataFrame | None = None) -> DataFrame:
    """Mean sales of rows with any markdown vs. rows with none, and the
    number of reported extreme markdown outliers (the capped list, as the
    report shows it) next to the true count of rows above a fence (both
    scalar subqueries)."""
    return run(df, markdown_effect_spec(df, outliers, above_fence))


def markdown_corr(df: DataFrame, digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of MarkDown* and the target, long
    form (col_a, col_b, corr), all ordered pairs as in a correlation matrix.

    The matrix is symmetric, so only unique pairs are computed, several per
    pass over the two or more columns they need: as many as keep the aggregate
    code-generated (see ``moments.in_groups``). The diagonal is 1 (null for a
    constant or empty column). Pairs skip rows where either side is null."""
    cols = markdown_columns(df) + [TARGET]
    if len(cols) == 1:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    def of_pair(a: str, b: str) -> dict:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        return {"corr": F.when(F.var_pop(x) > 0, F.lit(1.0)) if a == b else F.round(pearson(x, y), digits)}

    # buffers of a variance have 3 fields, of a covariance 4
    per_pair = by_groups(df, in_groups(pairs, lambda p: 3 if p[0] == p[1] else 10), of_pair)
    diag, corr = F.col("col_a") == F.col("col_b"), F.col("corr")
    one = F.struct(F.col("col_a"), F.col("col_b"), corr.alias("corr"))
    mirror = F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), corr.alias("corr"))
    return per_pair.select(F.inline(F.when(diag, F.array(one)).otherwise(F.array(one, mirror))))
