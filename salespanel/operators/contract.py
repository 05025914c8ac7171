"""Data contract: derive bounds from the data, then validate a table
against a contract with a PASS / FAIL verdict.

All per-column checks (dtype, nulls, primary-key nulls, target nulls and
bounds) are aggregates of ONE scan; the primary-key uniqueness check is one
grouped aggregation. The checks come back as a small DataFrame
(severity, rule, column_name, violations); only that table (a few rows per
contract column) is collected to phrase the messages.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespanel.functions.scalar import nan_to_null, number_text
from salespanel.operators.onerow import OneRow, run
from salespanel.schemas import (
    CONTRACT_DTYPES,
    CONTRACT_MARGIN,
    CONTRACT_MAX_FLOOR,
    CONTRACT_MIN_FLOOR,
    MARKDOWN_COLUMNS,
    PRIMARY_KEYS,
    TARGET,
)

# ---------------------------------------------------------------------------
# Contract layout and message formats of the validator.
# ---------------------------------------------------------------------------
CONTRACT_COLUMN_TYPES = (
    ("Store", "int", False), ("Dept", "int", False), ("Date", "datetime", False),
    (TARGET, "float", False), ("IsHoliday", "bool", False), ("Type", "string", True),
    ("Size", "int", True), ("Temperature", "float", True), ("Fuel_Price", "float", True),
    ("CPI", "float", True), ("Unemployment", "float", True),
    *[(c, "float", True) for c in MARKDOWN_COLUMNS],
)
MSG_MISSING_COLUMN = "Missing required column: '{col}'"
MSG_DTYPE = "Column '{col}' failed dtype check: expected '{dtype}', observed dtype '{observed}'"
MSG_UNKNOWN_DTYPE = "Unknown dtype '{dtype}' declared for column '{col}'; skipped type check"
MSG_NOT_NULL = "Column '{col}' is declared non-nullable but has {n} null value(s)"
MSG_PK_MISSING = "Primary key column '{col}' not present in data"
MSG_PK_NULL = "{n} row(s) have null value(s) in primary key columns {pk}"
MSG_PK_DUP = "{n} duplicate row(s) found for primary key {pk}"
MSG_TARGET_MISSING = "Target column '{col}' not present in data"
MSG_TARGET_NULL = "Target column '{col}' has {n} null value(s)"
MSG_BELOW = "{n} row(s) have '{col}' below the contract minimum of {bound}"
MSG_ABOVE = "{n} row(s) have '{col}' above the contract maximum of {bound}"
BOOL_TEXT = ("TRUE", "FALSE", "True", "False")
ISO_DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"
# ---------------------------------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


# ---- derivation ------------------------------------------------------------
def contract_bounds_spec(df: DataFrame, with_rows: bool = False, prefix: str = "cb_") -> OneRow:
    t = nan_to_null(F.col(TARGET))
    aggs = [F.min(t).alias(f"{prefix}observed_min"), F.max(t).alias(f"{prefix}observed_max"),
            F.count(F.lit(1)).alias(f"{prefix}rows")]

    def finish(w: DataFrame) -> DataFrame:
        lo, hi = F.col(f"{prefix}observed_min"), F.col(f"{prefix}observed_max")
        return w.select(
            lo.alias("observed_min"), hi.alias("observed_max"),
            *([F.col(f"{prefix}rows").alias("rows")] if with_rows else []),
            F.least(F.lit(CONTRACT_MIN_FLOOR), F.round(lo * CONTRACT_MARGIN, 2)).alias("min_bound"),
            F.greatest(F.lit(CONTRACT_MAX_FLOOR), F.round(hi * CONTRACT_MARGIN, 2)).alias("max_bound"))
    return OneRow(aggs, finish)


def contract_bounds(df: DataFrame, with_rows: bool = False) -> DataFrame:
    """One row: observed target min / max and the contract bounds
    min = least(-5000, round(1.1 * min, 2)), max = greatest(800000, round(1.1 * max, 2)).
    With no usable target the floors apply (least/greatest skip nulls)."""
    return run(df, contract_bounds_spec(df, with_rows))


def build_contract(df: DataFrame, bounds: DataFrame | None = None) -> dict[str, Any]:
    """The contract dict (primary keys, target, typed columns, target bounds).
    Collects one row of bounds and the row count (``bounds``: that row when
    already computed, e.g. by a shared aggregation pass)."""
    b = (bounds if bounds is not None else contract_bounds(df, with_rows=True)).first()
    columns: dict[str, dict[str, Any]] = {}
    for name, dtype, nullable in CONTRACT_COLUMN_TYPES:
        spec: dict[str, Any] = {"dtype": dtype, "nullable": nullable}
        if name == TARGET:
            spec["min"], spec["max"] = float(b["min_bound"]), float(b["max_bound"])
        columns[name] = spec
    return {
        "primary_keys": list(PRIMARY_KEYS),
        "target_column": TARGET,
        "columns": columns,
        "generated_from_row_count": int(b["rows"]),
        "generation_method": "deterministic: bounds derived from the observed target",
    }


# ---- validation ------------------------------------------------------------
def _dtype_violations(c: Column, t: T.DataType, declared: str) -> Column | None:
    """Count of non-null values that do not fit ``declared``; None when the
    declared type accepts the column's Spark type outright."""
    nn = c.isNotNull()

    def count(bad: Column) -> Column:
        return F.count_if(nn & bad)

    everything = count(F.lit(True))
    if declared == "string":
        return None
    if isinstance(t, T.BooleanType):
        return None if declared in ("int", "float", "bool") else everything
    if isinstance(t, _INTEGRAL):
        if declared in ("int", "float"):
            return None
        if declared == "bool":
            return count(~c.isin(0, 1))
        return everything  # numbers are not dates (pandas' epoch reading is not kept)
    if isinstance(t, _FRACTIONAL):
        d = c.cast("double")
        non_finite = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
        if declared == "float":
            return None
        if declared == "int":
            return count(non_finite | (F.rint(d) != d))
        if declared == "bool":
            return count(~d.isin(0.0, 1.0))
        return everything
    if isinstance(t, _TEMPORAL):
        return None if declared == "datetime" else everything
    if isinstance(t, T.StringType):
        if declared in ("int", "float"):
            d = number_text(c).try_cast("double")
            bad = d.isNull()
            if declared == "int":
                bad = bad | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))) | (F.rint(d) != d)
            return count(bad)
        if declared == "bool":
            return count(~c.isin(*BOOL_TEXT))
        # ISO date text (optionally with a time); bare numbers are not dates
        return count(c.try_cast("timestamp").isNull() | ~c.rlike(ISO_DATE_TEXT))
    return everything


@dataclass
class ValidationResult:
    status: str
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def as_dict(self) -> dict[str, Any]:
        return {"status": self.status, "errors": list(self.errors), "warnings": list(self.warnings)}


_CHECK_SCHEMA = "severity string, rule string, column_name string, violations bigint"


def contract_checks(df: DataFrame, contract: dict[str, Any]) -> DataFrame:
    """Every check of the contract as rows (severity, rule, column_name,
    violations). Schema-level findings (missing columns, unknown dtypes) are
    literal rows; data-level counts come from one aggregation pass plus one
    grouped count for duplicate keys."""
    spark = df.sparkSession
    spec: dict[str, Any] = contract.get("columns", {}) or {}
    pk: list[str] = list(contract.get("primary_keys", []) or [])
    target = contract.get("target_column")
    types = {f.name: f.dataType for f in df.schema.fields}

    static: list[tuple[str, str, str | None, int]] = []
    aggs: list[tuple[str, str, str, Column]] = []  # severity, rule, column, aggregate

    for col in spec:
        if col not in types:
            static.append(("error", "missing_column", col, 1))
    present = {c: s for c, s in spec.items() if c in types}
    for col, s in present.items():
        declared = (s or {}).get("dtype")
        if declared not in CONTRACT_DTYPES:
            static.append(("warning", "unknown_dtype", col, 0))
            continue
        v = _dtype_violations(F.col(col), types[col], declared)
        aggs.append(("error", "dtype", col, v if v is not None else F.lit(0).cast("long")))
    for col, s in present.items():
        if (s or {}).get("nullable", True) is False:
            aggs.append(("error", "not_null", col, F.count_if(F.col(col).isNull())))
    for col in pk:
        if col not in types:
            static.append(("error", "pk_missing", col, 1))
    usable_pk = [c for c in pk if c in types]
    if usable_pk:
        any_null = F.lit(False)
        for c in usable_pk:
            any_null = any_null | F.col(c).isNull()
        aggs.append(("error", "pk_null", ",".join(usable_pk), F.count_if(any_null)))
    if target:
        if target not in types:
            static.append(("error", "target_missing", target, 1))
        else:
            aggs.append(("error", "target_null", target, F.count_if(F.col(target).isNull())))
            ts = spec.get(target, {}) or {}
            num = nan_to_null(F.col(target).try_cast("double"))
            if ts.get("min") is not None:
                aggs.append(("error", "below_min", target, F.count_if(num < F.lit(float(ts["min"])))))
            if ts.get("max") is not None:
                aggs.append(("error", "above_max", target, F.count_if(num > F.lit(float(ts["max"])))))

    parts = []
    if static:
        parts.append(spark.createDataFrame(static, _CHECK_SCHEMA))
    if aggs:
        names = [f"c{i}" for i in range(len(aggs))]
        wide = df.agg(*[a[3].cast("long").alias(n) for a, n in zip(aggs, names)])
        meta = F.array(*[F.struct(F.lit(a[0]).alias("severity"), F.lit(a[1]).alias("rule"),
                                  F.lit(a[2]).alias("column_name"), F.col(n).alias("violations"))
                         for a, n in zip(aggs, names)])
        parts.append(wide.select(F.explode(meta).alias("m")).select("m.*"))
    if usable_pk:
        parts.append(pk_duplicates(df, usable_pk).select(
            F.lit("error").alias("severity"), F.lit("pk_duplicate").alias("rule"),
            F.lit(",".join(usable_pk)).alias("column_name"), F.col("duplicate_rows").alias("violations")))
    if not parts:
        return spark.createDataFrame([], _CHECK_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pk_duplicates(df: DataFrame, keys=PRIMARY_KEYS) -> DataFrame:
    """One row: rows beyond the first per key (null keys compare equal).
    One shuffle aggregation on the key with map-side partial counts."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def contract_verdict(checks: DataFrame) -> DataFrame:
    """One row: status PASS/FAIL, number of failed checks and of warnings."""
    return checks.agg(
        F.count_if((F.col("severity") == "error") & (F.col("violations") > 0)).alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    ).select(F.when(F.col("n_errors") > 0, "FAIL").otherwise("PASS").alias("status"),
             "n_errors", "n_warnings")


def validate(df: DataFrame, contract: dict[str, Any]) -> ValidationResult:
    """Validate ``df`` against ``contract``: any error -> FAIL; warnings never fail."""
    rows = contract_checks(df, contract).collect()
    spec = contract.get("columns", {}) or {}
    types = dict(df.dtypes)
    errors: list[str] = []
    warnings: list[str] = []
    order = ["missing_column", "unknown_dtype", "dtype", "not_null", "pk_missing", "pk_null",
             "pk_duplicate", "target_missing", "target_null", "below_min", "above_max"]
    rows = sorted(rows, key=lambda r: order.index(r.rule))
    for r in rows:
        col, n = r.column_name, r.violations
        if r.rule == "unknown_dtype":
            warnings.append(MSG_UNKNOWN_DTYPE.format(dtype=spec[col].get("dtype"), col=col))
            continue
        if not n:
            continue
        if r.rule == "missing_column":
            errors.append(MSG_MISSING_COLUMN.format(col=col))
        elif r.rule == "dtype":
            errors.append(MSG_DTYPE.format(col=col, dtype=spec[col]["dtype"], observed=types[col]))
        elif r.rule == "not_null":
            errors.append(MSG_NOT_NULL.format(col=col, n=n))
        elif r.rule == "pk_missing":
            errors.append(MSG_PK_MISSING.format(col=col))
        elif r.rule == "pk_null":
            errors.append(MSG_PK_NULL.format(n=n, pk=col.split(",")))
        elif r.rule == "pk_duplicate":
            errors.append(MSG_PK_DUP.format(n=n, pk=col.split(",")))
        elif r.rule == "target_missing":
            errors.append(MSG_TARGET_MISSING.format(col=col))
        elif r.rule == "target_null":
            errors.append(MSG_TARGET_NULL.format(col=col, n=n))
        elif r.rule == "below_min":
            errors.append(MSG_BELOW.format(n=n, col=col, bound=spec[col]["min"]))
        elif r.rule == "above_max":
            errors.append(MSG_ABOVE.format(n=n, col=col, bound=spec[col]["max"]))
    return ValidationResult("FAIL" if errors else "PASS", errors, warnings)
