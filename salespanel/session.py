"""Session helpers: build a session for tests/benchmarks and resolve the
shared folder used for checkpoints and written intermediate tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DIR_CONF = "spark.salespanel.localSharedDir"
# Target bytes per task for scans and shuffles: small enough to stay in
# executor memory without spilling much, large enough to keep task overhead low.
PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, partition_bytes: int = PARTITION_BYTES,
                           minimum: int = 8) -> int:
    """A starting ``spark.sql.shuffle.partitions`` for a job reading
    ``input_bytes``: one partition per ``partition_bytes`` of input (AQE then
    coalesces small ones and splits skewed ones at runtime)."""
    return max(minimum, -(-int(input_bytes) // int(partition_bytes)))


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "salespanel", extra: dict | None = None) -> SparkSession:
    """A session configured the way the engine expects (AQE on, UTC, no UI).

    On a cluster (``master=None``, as spark-submit decides, or any that isn't
    local) its shuffle partition count and driver memory stay as they are (``extra`` can set
    them, e.g. from ``shuffle_partitions_for``, about 256 MB per partition).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SALESPANEL_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if not (master or "").startswith("local"):  # a job on a cluster keeps the cluster's own sizing
        for k in ("spark.sql.shuffle.partitions", "spark.driver.memory"):
            conf.pop(k)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        v = spark.conf.get(key, None)
    except Exception:  # noqa: BLE001 - an unset key raises on some versions
        v = None
    return v or None


def app_id(spark: SparkSession) -> str:
    """The application id (read from the session conf, so it also works
    without a SparkContext handle, e.g. over Spark Connect)."""
    v = _conf(spark, "spark.app.id")
    if v:
        return v
    return spark.sparkContext.applicationId


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the shared one."""
    return f"{shared_dir(spark)}/salespanel-scratch/{app_id(spark)}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Call it once no
    DataFrame made before will be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Uses ``spark.checkpoint.dir`` (or a checkpoint dir already set on the
    context) as named by the cluster. Only when none is set *and* the master
    is local (tests, benchmarks) is a private temporary folder created; on a
    cluster an unset directory is an error, never a machine-local fallback.
    """
    d = _conf(spark, "spark.checkpoint.dir")
    sc = None
    if not d:
        try:
            sc = spark.sparkContext
            d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        except Exception:  # noqa: BLE001 - no context handle (Spark Connect)
            d = None
    if d:
        return d.rstrip("/")
    d = _conf(spark, _LOCAL_DIR_CONF)
    if d:
        return d
    master = _conf(spark, "spark.master") or (sc.master if sc is not None else "")
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder "
            "(HDFS/object store) that every executor can reach")
    d = tempfile.mkdtemp(prefix="salespanel-")
    if sc is not None:
        sc.setCheckpointDir(d)
    spark.conf.set(_LOCAL_DIR_CONF, d)
    return d
