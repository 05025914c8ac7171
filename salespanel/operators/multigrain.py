"""Findings of several grains from few passes over the clean table.

``grains`` is ONE aggregation by grouping sets: rows and mean sales per
department, per store and holiday flag and per month, and the value counts of
every markdown column. Its partial rows merge before the shuffle, so what
travels follows the number of groups. The department list, the holiday spikes,
the trend and the markdown quartiles are read from its written result.

``samples`` is ONE scan for the record-level lists: zero, negative and outlying
rows are ranked by kind, each task keeping the few rows that can be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from salespanel.functions.scalar import exact_mean
from salespanel.operators.insight import markdown_columns
from salespanel.operators.inspect import fences, iqr_of_quartiles, ranked_spikes
from salespanel.operators.quantiles import WALK, quantiles_of_counts, widest
from salespanel.schemas import (
    ANOMALY_TOP_N,
    HOLIDAY_SPIKE_TOP_N,
    MICRO_INSPECTION_SAMPLE_SIZE,
    OUTLIERS_PER_COLUMN,
    TARGET,
)

ZERO, NEGATIVE = "zero", "negative"


def _sets(df: DataFrame) -> dict[str, list[str]]:
    """Grouping columns by grain; a grain of absent columns is left out."""
    sets = {"dept": ["Dept"], "month": ["Month"]}
    if "IsHoliday" in df.columns:
        sets["holiday"] = ["Store", "IsHoliday"]
    return sets | {c: [c] for c in markdown_columns(df)}


def grains(df: DataFrame) -> DataFrame:
    """(grain, its columns, n, mean_sales): one row per group of each grain, other columns null."""
    sets = _sets(df)
    cols = list(dict.fromkeys(c for s in sets.values() for c in s))
    month = F.date_format("Date", "yyyy-MM").alias("Month")
    work = df.select(*[month if c == "Month" else F.col(c) for c in cols], TARGET)
    # grouping_id has a bit a column, set where the column is not grouped by
    of_id = {sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s): name for name, s in sets.items()}
    grain: Column = F.lit(None).cast("string")
    for i, name in of_id.items():
        grain = F.when(F.grouping_id() == i, F.lit(name)).otherwise(grain)
    return work.groupingSets([[F.col(c) for c in s] for s in sets.values()], *cols).agg(
        grain.alias("grain"), F.count(F.lit(1)).alias("n"), exact_mean(TARGET).alias("mean_sales"))


def _of(written: DataFrame, grain: str) -> DataFrame:
    return written.filter(F.col("grain") == grain)


def dept_top10(written: DataFrame, n: int = HOLIDAY_SPIKE_TOP_N) -> DataFrame:
    """``profile.dept_top10`` from the grains."""
    return _of(written, "dept").select("Dept", F.col("n").alias("n_rows")).orderBy(F.desc("n_rows"), F.asc("Dept")).limit(n)


def monthly_trend(written: DataFrame) -> DataFrame:
    """``insight.monthly_trend`` from the grains."""
    return _of(written, "month").select("Month", "mean_sales").orderBy("Month")


def holiday_spikes(written: DataFrame, n: int = HOLIDAY_SPIKE_TOP_N) -> DataFrame:
    """``inspect.holiday_spikes`` from the grains; a store has one row a flag."""
    mean = lambda flag: F.max(F.when(F.col("IsHoliday") == flag, F.col("mean_sales")))
    means = _of(written, "holiday").groupBy("Store").agg(mean(True).alias("holiday_mean"), mean(False).alias("non_holiday_mean"))
    return ranked_spikes(means, n)


def markdown_iqr_bounds(written: DataFrame, n_rows: int, md: list[str]) -> DataFrame:
    """``inspect.markdown_iqr_bounds`` from the grains' value counts; ``n_rows`` is the number of all rows."""
    value = F.coalesce(*[F.when(F.col("grain") == c, F.col(c).cast("double")) for c in md])
    counts = written.filter(F.col("grain").isin(md)).select(F.col("grain").alias("md_column"), value.alias("value"), F.col("n").alias("__w"))
    counts = counts.filter(F.col("value").isNotNull())
    most = widest(counts, ["md_column"], n_rows, WALK)
    return iqr_of_quartiles(quantiles_of_counts(counts, "value", [0.25, 0.75], ["q1", "q3"], ["md_column"], most))


def samples(df: DataFrame, bounds: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(kind, place, Store, Dept, Date, Weekly_Sales, value, fence): the first rows
    of each kind in its order. Kinds are ZERO, NEGATIVE and the markdown
    columns, whose rows are above their fence. ``observation`` counts
    rows_above_fence while the rows are read."""
    md = markdown_columns(df)
    fence = fences(bounds, md) if md else None
    none = F.lit(None).cast("double")

    def entry(kind: str, here: Column, order: Column, value: Column, limit: Column) -> Column:
        return F.when(here, F.struct(F.lit(kind).alias("kind"), order.alias("order"), value.alias("value"), limit.alias("fence")))

    entries = [entry(ZERO, F.col(TARGET) == 0, F.lit(0.0), none, none),
               entry(NEGATIVE, F.col(TARGET) < 0, F.col(TARGET).cast("double"), none, none)]
    above = F.lit(False)
    for c in md:
        v = F.col(c).cast("double")
        above = above | F.coalesce(v > fence[c], F.lit(False))
        entries.append(entry(c, v > fence[c], -v, v, fence[c]))
    if observation is not None:
        df = df.observe(observation, F.count_if(above).alias("rows_above_fence"))
    rows = df.filter((F.col(TARGET) <= 0) | above).select("Store", "Dept", "Date", TARGET, F.explode(F.array_compact(F.array(*entries))).alias("e"))
    rows = rows.select("Store", "Dept", "Date", TARGET, "e.*")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("order", "Store", "Dept", "Date"))
    most = max(MICRO_INSPECTION_SAMPLE_SIZE, OUTLIERS_PER_COLUMN)
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("order")


def sales_sample(written: DataFrame, kind: str, n: int = MICRO_INSPECTION_SAMPLE_SIZE) -> DataFrame:
    """``inspect.zero_sales`` or ``inspect.negative_sales`` from the samples."""
    return written.filter((F.col("kind") == kind) & (F.col("place") <= n)).orderBy("place").select("Store", "Dept", "Date", TARGET)


def markdown_outliers(written: DataFrame, md: list[str], per_column: int = OUTLIERS_PER_COLUMN, cap: int = ANOMALY_TOP_N) -> DataFrame:
    """``inspect.markdown_outliers`` from the samples."""
    column = F.array_position(F.array(*[F.lit(c) for c in md]), F.col("kind"))
    return (written.filter(F.col("kind").isin(md) & (F.col("place") <= per_column)).orderBy(column, "place").limit(cap)
            .select(F.col("kind").alias("md_column"), "Store", "Dept", "Date", "value", F.round("fence", 2).alias("upper_bound"),
                    F.col("place").alias("rank_in_column")))
