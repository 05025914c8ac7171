"""JSON documents and model artifacts of a run, written and read with Spark.

A document is a one-row DataFrame with a declared schema, written as JSON
into its own folder (so it lives on the same shared storage as the tables);
reading it back uses the same schema, never inference."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from salespanel.schemas import CONTRACT_SCHEMA, EVALUATION_REPORT_SCHEMA, RUN_METADATA_SCHEMA

VALIDATION_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])


def _to_plain(v):
    if isinstance(v, T.Row):
        return {k: _to_plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _to_plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_to_plain(x) for x in v]
    return v


def write_document(spark: SparkSession, doc: dict[str, Any], schema: T.StructType, path: str) -> None:
    row = {f.name: doc.get(f.name) for f in schema.fields}
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def read_document(spark: SparkSession, schema: T.StructType, path: str) -> dict[str, Any] | None:
    rows = spark.read.schema(schema).json(path).take(1)
    return _to_plain(rows[0]) if rows else None


def _drop_nulls(d):
    if isinstance(d, dict):
        return {k: _drop_nulls(v) for k, v in d.items() if v is not None}
    return d


# contract (K2 / S4) ----------------------------------------------------------
def write_contract(spark: SparkSession, contract: dict[str, Any], path: str) -> None:
    write_document(spark, contract, CONTRACT_SCHEMA, path)


def load_contract(spark: SparkSession, path: str) -> dict[str, Any]:
    doc = read_document(spark, CONTRACT_SCHEMA, path)
    if doc is None:
        raise FileNotFoundError(path)
    doc["columns"] = {k: _drop_nulls(v) for k, v in (doc.get("columns") or {}).items()}
    return doc


def load_contract_file(spark: SparkSession, path: str) -> dict[str, Any]:
    """A contract kept as a plain JSON file (a few hundred bytes), on any file
    system that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# validation result (K3) ------------------------------------------------------
def write_validation(spark: SparkSession, result: dict[str, Any], path: str) -> None:
    write_document(spark, result, VALIDATION_SCHEMA, path)


# evaluation report (K4 / S6) -------------------------------------------------
def write_evaluation_report(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    write_document(spark, report, EVALUATION_REPORT_SCHEMA, path)


def load_evaluation_report(spark: SparkSession, path: str) -> dict[str, Any] | None:
    from salespanel.sources.raw import path_exists
    if not path_exists(spark, path):
        return None
    return read_document(spark, EVALUATION_REPORT_SCHEMA, path)


# run metadata (K6) -----------------------------------------------------------
def write_run_metadata(spark: SparkSession, state: dict[str, Any], path: str) -> None:
    write_document(spark, state, RUN_METADATA_SCHEMA, path)


# model (K5 / S7) -------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    from salespanel.sources.raw import path_exists
    if not path_exists(spark, path):
        return None
    return PipelineModel.load(path)


def write_table(df: DataFrame, path: str) -> None:
    """A finding / report table as Parquet."""
    df.write.mode("overwrite").parquet(path)
