"""Leakage-safe feature engineering per (Store, Dept) series.

Lags and the shifted rolling statistics only look at rows strictly before
the current one. All lag columns come from ONE window specification
(partition by Store, Dept; order by Date), so the whole family costs one
exchange and one sort. A series holds at most one row per week (the primary
key), so a window partition is bounded by the number of weeks, however
large the table grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salespanel.operators.categories import Categories, encode_sparse
from salespanel.operators.quantiles import WALK, quantiles_of_counts, stored, widest
from salespanel.schemas import (
    ECONOMIC_COLUMNS,
    ENGINEERED_COLUMNS,
    LAG_PERIODS,
    MARKDOWN_COLUMNS,
    PRIMARY_KEYS,
    ROLLING_WINDOW,
    SERIES_KEYS,
    TARGET,
)

IDENTIFIERS = PRIMARY_KEYS


def series_window():
    return Window.partitionBy(*SERIES_KEYS).orderBy("Date")


def _lag_name(k: int) -> str:
    return f"__lag{k}"


def add_lags(df: DataFrame, periods=None) -> DataFrame:
    """Private lag columns 1..max(lags, rolling width) of the target."""
    need = sorted(set(periods or LAG_PERIODS) | set(range(1, ROLLING_WINDOW + 1)))
    w = series_window()
    return df.withColumns({_lag_name(k): F.lag(TARGET, k).over(w) for k in need})


def lag_columns(df: DataFrame) -> DataFrame:
    """Weekly_Sales_Lag1 / _Lag4 from the private lags (rows, not weeks)."""
    return df.withColumns({f"{TARGET}_Lag{k}": F.col(_lag_name(k)) for k in LAG_PERIODS})


def rolling_columns(df: DataFrame, width: int = ROLLING_WINDOW) -> DataFrame:
    """Mean and sample std of the ``width`` rows before the current one,
    null unless all of them exist and are non-null.

    The frame is fixed and small, so it is written over the lag columns of
    the shared window: mean = (x[t-w] + ... + x[t-1]) / w and
    std = sqrt(sum((x - mean)^2) / (w - 1)). No second window, and the
    arithmetic is the same in every engine, row by row.
    """
    lags = [F.col(_lag_name(k)) for k in range(width, 0, -1)]
    complete = F.lit(True)
    for c in lags:
        complete = complete & c.isNotNull()
    total = lags[0]
    for c in lags[1:]:
        total = total + c
    mean = total / F.lit(float(width))
    sq = (lags[0] - mean) * (lags[0] - mean)
    for c in lags[1:]:
        sq = sq + (c - mean) * (c - mean)
    std = F.sqrt(sq / F.lit(float(width - 1)))
    return df.withColumns({
        f"{TARGET}_RollingMean{width}": F.when(complete, mean),
        f"{TARGET}_RollingStd{width}": F.when(complete, std),
    })


def drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def impute_markdowns(df: DataFrame) -> DataFrame:
    """Zero-fill the MarkDown columns that are present (null = no markdown)."""
    present = [c for c in MARKDOWN_COLUMNS if c in df.columns]
    return df.fillna(0.0, subset=present) if present else df


def value_histogram(df: DataFrame, cols) -> DataFrame:
    """(column, Store, value, n): how often each value of each column occurs
    per store (value null counts the gaps). One pass over ``df`` with
    map-side partial counts; its size follows the distinct values per store,
    not the rows."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                  for c in cols]))
    return (df.select("Store", stacked.alias("s")).select("Store", "s.*")
              .groupBy("column", "Store", "value").agg(F.count(F.lit(1)).alias("n")))


class _Fill:
    """The medians that fill gaps, from one histogram written to the scratch
    folder; both are lazy. A second job sizes its groups if it has more rows
    than are walked at once."""

    def __init__(self, fit: DataFrame, cols):
        hist, n = stored(value_histogram(fit, cols), "histogram")
        self.hist = hist.withColumnRenamed("n", "__w")
        self.by_store = widest(hist, ["column", "Store"], n, WALK)
        self.by_column = widest(hist, ["column"], n, WALK)
        self.seen = self.hist.filter(F.col("value").isNotNull())

    def store_medians(self) -> DataFrame:
        """column, Store, store_median"""
        return quantiles_of_counts(self.seen, "value", [0.5], ["store_median"], ["column", "Store"], self.by_store)

    def global_medians(self, med: DataFrame) -> DataFrame:
        """column, global_median of the store-filled column: the same values, plus each store's gaps at its median."""
        gaps = self.hist.filter(F.col("value").isNull()).join(med, ["column", "Store"])
        filled = self.seen.select("column", "value", "__w").unionByName(
            gaps.select("column", F.col("store_median").alias("value"), "__w"))
        return quantiles_of_counts(filled, "value", [0.5], ["global_median"], ["column"], self.by_column)


def store_medians(df: DataFrame, cols=ECONOMIC_COLUMNS) -> DataFrame:
    """Per-store exact median of each economic column (nulls skipped), one
    row per store: Store, <col>_store_median ..."""
    present = [c for c in cols if c in df.columns]
    med = _Fill(df, present).store_medians()
    return med.groupBy("Store").pivot("column", present).agg(F.first("store_median")) \
              .select("Store", *[F.col(c).alias(f"{c}_store_median") for c in present])


def _approx_fill_values(fit: DataFrame, present: list[str], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Opt-in approximate medians: ``percentile_approx`` sketches (bounded
    memory, one pass each); the global one is taken over the store-filled
    values, as in the exact path."""
    med = fit.groupBy("Store").agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in present])
    med_long = med.select("Store", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("store_median")) for c in present]))
        .alias("m")).select("Store", "m.*")
    filled = fit.join(med, "Store", "left").select(
        *[F.coalesce(fit[c], med[c]).alias(c) for c in present])
    glob = filled.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in present])).alias("g")) \
        .select("g.*").groupBy("column").agg(F.percentile_approx("v", 0.5, accuracy).alias("global_median"))
    return med_long, glob


def impute_economic(df: DataFrame, cols=ECONOMIC_COLUMNS, fit: DataFrame | None = None,
                    approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Fill CPI / Unemployment gaps with the store's median, then any store
    with no value at all with the global median of the store-filled column
    (row weighted, as in the reference; order matters).

    ``fit`` (default: ``df`` itself, i.e. the whole history as the
    reference does) chooses the rows the medians are learned from; pass the
    training rows to keep the hold-out out of the fill. ``approx=True`` uses
    ``percentile_approx`` sketches instead of the exact medians.

    Plan: ONE histogram pass over ``fit`` gives both medians (the global
    one is the weighted median of observed values plus each store's gaps
    at its store median: the store-filled column without building it);
    then one pass over ``df`` joins the per-store medians on Store (AQE
    broadcasts them when their measured size allows); the global medians are
    one scalar subquery.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    fit = df if fit is None else fit
    if approx:
        med, glob = _approx_fill_values(fit, present, accuracy)
    else:
        fill = _Fill(fit, present)
        med = fill.store_medians()
        glob = fill.global_medians(med)
    med_w = (med.groupBy("Store").pivot("column", present).agg(F.first("store_median"))
                .select("Store", *[F.col(c).alias(f"__sm_{c}") for c in present]))
    gm = glob.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("global_median"))).alias(c)
                             for c in present])).scalar()
    out = df.join(med_w, "Store", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__sm_{c}"), gm[c]) for c in present})
    return out.select(*df.columns)


# A wider one-hot encoding takes a sparse vector (``operators/categories``) instead of columns.
MAX_CATEGORIES = 1000


def observed_types(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> list[str]:
    """Sorted distinct non-null store types (a handful of values). At most
    ``max_categories + 1`` values ever reach the driver; more is an error."""
    if "Type" not in df.columns:
        return []
    got = [r[0] for r in df.select("Type").dropna().distinct().limit(max_categories + 1).collect()]
    if len(got) > max_categories:
        raise ValueError(f"Type has more than {max_categories} distinct values, too many for columns of their own; "
                         "fit_categories() and engineer_features(categories=...) give them one sparse vector")
    return sorted(got)


def encode_categoricals(df: DataFrame, types: list[str] | None = None, categories: Categories | None = None) -> DataFrame:
    """IsHoliday -> 0/1; Type -> one 0/1 column per observed value, sorted and
    appended last (a null Type is all zeros), Type dropped.

    ``types`` fixes the category list (keep the training list when scoring);
    by default it is read from the data, as the reference does. With fitted
    ``categories``, of any number, Type becomes one sparse vector instead.
    """
    if "IsHoliday" in df.columns:
        df = df.withColumn("IsHoliday", F.col("IsHoliday").cast("int"))
    if "Type" in df.columns and categories is not None:
        return encode_sparse(df, categories)
    if "Type" in df.columns:
        types = observed_types(df) if types is None else list(types)
        cols = [c for c in df.columns if c != "Type"]
        df = df.select(*cols, *[F.when(F.col("Type") == v, 1).otherwise(0).alias(f"Type_{v}")
                                for v in types])
    return df


def drop_cold_start(df: DataFrame) -> DataFrame:
    """Rows lacking any engineered value (the first weeks of a series)."""
    return df.dropna(subset=list(ENGINEERED_COLUMNS))


def engineer_features(df: DataFrame, types: list[str] | None = None,
                      fit: DataFrame | None = None, prelagged: bool = False, categories: Categories | None = None) -> DataFrame:
    """The full feature table: lags -> rolling -> markdown fill -> economic
    fill -> encoding -> cold-start drop. ``prelagged``: ``df`` already went
    through ``add_lags`` (the window is shared with other consumers)."""
    base = df if prelagged else add_lags(df)
    out = drop_private(rolling_columns(lag_columns(base)))
    out = impute_markdowns(out)
    out = impute_economic(out, fit=fit)
    out = encode_categoricals(out, types, categories)
    return drop_cold_start(out)


def modelled_dates(lagged: DataFrame) -> DataFrame:
    """The (Store, Dept, Date) rows that survive the cold-start drop, from a
    table carrying the shared lags; imputation never removes rows, so these
    are exactly the feature table's rows."""
    return drop_cold_start(drop_private(rolling_columns(lag_columns(lagged)))).select("Date")


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: every column but the identifiers and the target, in order."""
    drop = set(IDENTIFIERS) | {TARGET}
    return [c for c in df.columns if c not in drop]
