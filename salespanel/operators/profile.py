"""Profiling: counts, date range, cardinality, nulls, department breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.operators.onerow import OneRow, run
from salespanel.schemas import HOLIDAY_SPIKE_TOP_N


def profile_summary_spec(df: DataFrame, prefix: str = "ps_", approx: bool = False) -> OneRow:
    """Row/column counts, date range, distinct stores and departments (nulls
    not counted); ``count_distinct`` is exact (``approx_count_distinct`` when
    an estimate is enough)."""
    cols = df.columns
    p = prefix
    aggs = [F.count(F.lit(1)).alias(f"{p}row_count")]
    aggs += ([F.min("Date").alias(f"{p}min_date"), F.max("Date").alias(f"{p}max_date")]
             if "Date" in cols else
             [F.lit(None).cast("date").alias(f"{p}min_date"), F.lit(None).cast("date").alias(f"{p}max_date")])
    for c, name in (("Store", "store_count"), ("Dept", "dept_count")):
        distinct = F.approx_count_distinct(c) if approx else F.count_distinct(c)
        aggs.append((distinct if c in cols else F.lit(None).cast("long")).alias(f"{p}{name}"))

    def finish(w: DataFrame) -> DataFrame:
        return w.select(F.col(f"{p}row_count").alias("row_count"), F.lit(len(cols)).alias("column_count"),
                        *[F.col(f"{p}{n}").alias(n) for n in ("min_date", "max_date", "store_count", "dept_count")])
    return OneRow(aggs, finish)


def profile_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: row/column counts, date range, distinct stores and departments
    (``approx=True``: HyperLogLog estimates, no distinct-value shuffle)."""
    return run(df, profile_summary_spec(df, approx=approx))


def null_profile_spec(df: DataFrame, digits: int = 3, prefix: str = "np_") -> OneRow:
    """Null count of every column in the same pass; the finish step keeps
    the columns that have nulls: (column_name, null_count, null_pct), with
    max(rows, 1) as the percentage denominator."""
    cols = df.columns
    p = prefix
    aggs = [F.count(F.lit(1)).alias(f"{p}_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{p}{c}") for c in cols]]

    def finish(w: DataFrame) -> DataFrame:
        wide = w.select(F.col(f"{p}_rows").alias("__rows"), *[F.col(f"{p}{c}").alias(c) for c in cols])
        long = wide.unpivot(["__rows"], cols, "column_name", "null_count")
        return (long.filter(F.col("null_count") > 0)
                    .select("column_name", "null_count",
                            F.round(F.col("null_count") / F.greatest(F.col("__rows"), F.lit(1)) * 100.0,
                                    digits).alias("null_pct")))
    return OneRow(aggs, finish)


def null_profile(df: DataFrame, digits: int = 3) -> DataFrame:
    """Columns that hold nulls: (column_name, null_count, null_pct)."""
    return run(df, null_profile_spec(df, digits))


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    """Column name and Spark type of every column (schema only, no job)."""
    return list(df.dtypes)


def dept_top10(df: DataFrame, n: int = HOLIDAY_SPIKE_TOP_N) -> DataFrame:
    """Row count per department, the ``n`` largest (ties by Dept)."""
    return (df.groupBy("Dept").agg(F.count(F.lit(1)).alias("n_rows"))
              .orderBy(F.desc("n_rows"), F.asc("Dept")).limit(n))
