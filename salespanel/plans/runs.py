"""Run history: one folder per run under an artifacts root.

Each run writes ``run_started`` when it begins and ``run_metadata`` when it
ends (FAILED or COMPLETED). Every folder under the root is a run; a Spark scan
of both documents across all of them is joined to it on the run id. A run
without metadata is IN_PROGRESS, one whose metadata cannot be parsed is UNKNOWN."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespanel.schemas import RUN_METADATA_SCHEMA

STARTED_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()),
                               T.StructField("started_at", T.StringType())])
DESCRIPTIVE_STATUSES = ("VALIDATED", "SCIENTIST_COMPLETE", "COMPLETED")
PREDICTIVE_STATUSES = ("COMPLETED",)


def _run_id_from_path(doc: str) -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{doc}/[^/]+$", 1)


def _scan(spark: SparkSession, root: str, doc: str, schema: T.StructType) -> DataFrame | None:
    try:
        return (spark.read.schema(schema).option("mode", "PERMISSIVE")
                .json(f"{root.rstrip('/')}/*/{doc}/*.json")
                .withColumn("__dir_run_id", _run_id_from_path(doc)))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_ids(spark: SparkSession, root: str) -> list[str]:
    """Names of the run folders under ``root`` (none if it does not exist)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs under ``root``, newest run id first, with their status."""
    meta_schema = T.StructType([*RUN_METADATA_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    started = _scan(spark, root, "run_started", STARTED_SCHEMA)
    meta = _scan(spark, root, "run_metadata", meta_schema)
    s = spark.createDataFrame([(r,) for r in run_ids(spark, root)], "run_id string")
    if started is None:
        started = spark.createDataFrame([], "__dir_run_id string, started_at string")
    if meta is None:
        meta = spark.createDataFrame([], T.StructType([*meta_schema.fields, T.StructField("__dir_run_id", T.StringType())]))
    s = s.join(started.select(F.col("__dir_run_id").alias("run_id"), F.col("started_at").alias("__started")), "run_id", "left")
    m = meta.withColumn("run_id", F.col("__dir_run_id")).drop("__dir_run_id")
    m = m.withColumn("__bad", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")
    joined = s.join(m, "run_id", "left")
    status = (F.when(F.col("__bad"), F.lit("UNKNOWN"))
               .when(F.col("status").isNull(), F.lit("IN_PROGRESS"))
               .otherwise(F.col("status")))
    cols = [c for c in RUN_METADATA_SCHEMA.fieldNames() if c not in ("run_id", "status", "started_at")]
    return (joined.select("run_id", status.alias("status"),
                          F.coalesce("started_at", "__started").alias("started_at"), *cols)
                  .orderBy(F.desc("run_id")))


def runs_with_status(runs: DataFrame, statuses) -> DataFrame:
    """Runs whose status is one of ``statuses`` (e.g. the dashboard filters)."""
    return runs.filter(F.col("status").isin(*statuses))


def failed_run_errors(runs: DataFrame) -> DataFrame:
    """One row per validation error of each FAILED run (runs without errors
    keep one row with a null error)."""
    return (runs.filter(F.col("status") == "FAILED")
                .select("run_id", "contract_status", F.explode_outer("validation_errors").alias("error")))


def failed_run_messages(runs: DataFrame) -> DataFrame:
    """One row (run_id, contract_status, severity, message) per validation
    error and warning of each FAILED run."""
    def messages(column: str, severity: str) -> F.Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")),
                           lambda m: F.struct(F.lit(severity).alias("severity"), m.alias("message")))
    both = F.concat(messages("validation_errors", "error"), messages("validation_warnings", "warning"))
    return (runs.filter(F.col("status") == "FAILED")
                .select("run_id", "contract_status", F.inline(both)))


def run_history(runs: DataFrame) -> DataFrame:
    """The admin view: id, status, contract status, selected model, times."""
    return runs.select("run_id", "status", "contract_status", "selected_model_name", "started_at", "finished_at")
