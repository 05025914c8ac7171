"""Column names, source schemas and other fixed values of the panel."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
REQUIRED_SOURCE_FILES = ("stores.csv", "features.csv", "train.csv")
PRIMARY_KEYS = ("Store", "Dept", "Date")
SERIES_KEYS = ("Store", "Dept")
TARGET = "Weekly_Sales"
MARKDOWN_COLUMNS = ("MarkDown1", "MarkDown2", "MarkDown3", "MarkDown4", "MarkDown5")
ECONOMIC_COLUMNS = ("CPI", "Unemployment")
LAG_PERIODS = (1, 4)
ROLLING_WINDOW = 4
TRAIN_FRACTION = 0.8
MICRO_INSPECTION_SAMPLE_SIZE = 15
HOLIDAY_SPIKE_TOP_N = 10
ANOMALY_TOP_N = 15
OUTLIERS_PER_COLUMN = 5
IQR_FENCE_MULTIPLIER = 3
CONTRACT_MIN_FLOOR = -5000.0
CONTRACT_MAX_FLOOR = 800000.0
CONTRACT_MARGIN = 1.1
CONTRACT_DTYPES = ("int", "float", "bool", "datetime", "string")
# Text the CSV reader treats as missing (pandas' default null token set).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null")
# ---------------------------------------------------------------------------

ENGINEERED_COLUMNS = (
    f"{TARGET}_Lag1", f"{TARGET}_Lag4",
    f"{TARGET}_RollingMean{ROLLING_WINDOW}", f"{TARGET}_RollingStd{ROLLING_WINDOW}",
)

# Clean-table column order after both joins.
CLEAN_COLUMNS = ("Store", "Dept", "Date", TARGET, "IsHoliday", "Type", "Size",
                 "Temperature", "Fuel_Price", *MARKDOWN_COLUMNS, *ECONOMIC_COLUMNS)

# Typed layout of the three raw sources (columns are read as text first).
STORES_TYPES = {"Store": "bigint", "Type": "string", "Size": "bigint"}
FEATURES_TYPES = {"Store": "bigint", "Date": "date", "Temperature": "double",
                  "Fuel_Price": "double", **{c: "double" for c in MARKDOWN_COLUMNS},
                  "CPI": "double", "Unemployment": "double", "IsHoliday": "boolean"}
TRAIN_TYPES = {"Store": "bigint", "Dept": "bigint", "Date": "date", TARGET: "double",
               "IsHoliday": "boolean"}
SOURCE_TYPES = {"stores": STORES_TYPES, "features": FEATURES_TYPES, "train": TRAIN_TYPES}

CONTRACT_SCHEMA = T.StructType([
    T.StructField("primary_keys", T.ArrayType(T.StringType())),
    T.StructField("target_column", T.StringType()),
    T.StructField("columns", T.MapType(T.StringType(), T.StructType([
        T.StructField("dtype", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]))),
    T.StructField("generated_from_row_count", T.LongType()),
    T.StructField("generation_method", T.StringType()),
])

# Field names of the run documents are fixed values too.
RUN_METADATA_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_dir", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("clean_data_path", T.StringType()),
    T.StructField("contract_path", T.StringType()),
    T.StructField("contract_status", T.StringType()),
    T.StructField("validation_errors", T.ArrayType(T.StringType())),
    T.StructField("validation_warnings", T.ArrayType(T.StringType())),
    T.StructField("selected_model_name", T.StringType()),
    T.StructField("candidate_metrics", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("started_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("rows_dropped", T.LongType()),
])

EVALUATION_REPORT_SCHEMA = T.StructType([
    T.StructField("selected_model_name", T.StringType()),
    T.StructField("candidate_metrics", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("target_column", T.StringType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("test_rows", T.LongType()),
    T.StructField("split_cutoff_date", T.StringType()),
])
