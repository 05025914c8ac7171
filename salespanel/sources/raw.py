"""Raw CSV sources (stores.csv, features.csv, train.csv) and the clean table.

CSVs are read as text (no schema inference), the null-token set is mapped
to null and every known column is parsed with a ``try_*`` conversion, so a
malformed cell becomes null instead of failing the job (ANSI mode)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespanel.functions.scalar import coerce_bool, null_tokens_to_null, typed
from salespanel.operators.ingest import DataIngestionError
from salespanel.schemas import REQUIRED_SOURCE_FILES, SOURCE_TYPES


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` resolves (the reader lists it without reading data)."""
    try:
        spark.read.format("text").load(path)
        return True
    except AnalysisException as e:
        cond = (e.getCondition() if hasattr(e, "getCondition") else e.getErrorClass()) or ""
        if "PATH_NOT_FOUND" in cond or "Path does not exist" in str(e):
            return False
        raise


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column as text."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("mode", "PERMISSIVE").option("nullValue", "").csv(path))


def type_columns(df: DataFrame, types: dict[str, str], unknown_bool: str = "null") -> DataFrame:
    """Parse the known columns of a text table to their types; other columns
    stay text."""
    out = []
    for c in df.columns:
        t = types.get(c)
        if t is None:
            out.append(F.col(c))
        elif t == "boolean":
            out.append(coerce_bool(null_tokens_to_null(c), unknown_bool).alias(c))
        else:
            out.append(typed(c, t).alias(c))
    return df.select(*out)


def load_raw_tables(spark: SparkSession, raw_dir: str, unknown_bool: str = "null") -> dict[str, DataFrame]:
    """{stores, features, train} from ``raw_dir``; one error lists every
    missing file."""
    raw_dir = raw_dir.rstrip("/")
    missing = [f for f in REQUIRED_SOURCE_FILES if not path_exists(spark, f"{raw_dir}/{f}")]
    if missing:
        raise DataIngestionError(
            f"{raw_dir} lacks {', '.join(missing)}; a raw folder holds {', '.join(REQUIRED_SOURCE_FILES)}")
    out = {}
    for f in REQUIRED_SOURCE_FILES:
        name = f.split(".")[0]
        out[name] = type_columns(read_text_csv(spark, f"{raw_dir}/{f}"), SOURCE_TYPES[name], unknown_bool)
    return out


def write_clean(df: DataFrame, path: str, globally_sorted: bool = False, csv_path: str | None = None) -> None:
    """Write the clean table as Parquet (parallel part files).

    Rows are sorted by (Store, Dept, Date) inside each file, which keeps the
    Parquet min/max statistics tight for Store/Date filters.
    ``globally_sorted`` range-partitions first so the part files are in key
    order as well (one extra sampling pass). ``csv_path`` also exports the written
    table as CSV part files with a header.
    """
    keys = ["Store", "Dept", "Date"]
    out = df.repartitionByRange(*keys) if globally_sorted else df
    out = out.sortWithinPartitions(*keys)
    out.write.mode("overwrite").parquet(path)
    if csv_path:
        read_clean(df.sparkSession, path).write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(csv_path)


def write_series(df: DataFrame, path: str, csv_path: str | None = None) -> DataFrame:
    """Write the clean table (Parquet files at ``path``) with each series,
    (Store, Dept), whole in one bucket and in order of Date, and return it.

    The shuffle is paid once, here. What is read from the returned table is
    known to lie by series, so lags, changes from week to week and the check
    for repeated keys need no exchange of their own. There are as many buckets
    as shuffle partitions, one file each. The table is temporary in the
    session's catalog; ``read_clean`` reads the same files anywhere, without
    that knowledge."""
    spark = df.sparkSession
    series, keys = ["Store", "Dept"], ["Store", "Dept", "Date"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"salespanel_clean_{uuid.uuid4().hex}"
    (df.repartition(buckets, *series).write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(buckets, *series).sortBy(*keys).saveAsTable(name))
    if csv_path:
        read_clean(spark, path).write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(csv_path)
    return spark.table(name)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The clean table written by ``write_clean``."""
    return spark.read.parquet(path).withColumn("Date", F.col("Date").cast("date"))
