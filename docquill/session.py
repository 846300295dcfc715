"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces small
# shuffle partitions; skew-join splitting handles a hot path or source; Arrow
# batches bound the memory of the single Python stage (annotation).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "docquill", conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's base settings plus
    ``conf``. The cluster's shuffle partitions and driver memory stay as they
    are, unless given here (``DOCQUILL_DRIVER_MEMORY`` for the latter)."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("DOCQUILL_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", os.environ["DOCQUILL_DRIVER_MEMORY"])
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when it is unset (local tests) do we pick a folder of our own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="docquill-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def ship_package(spark: SparkSession | None = None) -> None:
    """Make this package's code travel with the tasks that need it.

    Python stages (the model call, an exact token counter) run functions and
    objects defined here on executors. Registering the package with
    PySpark's cloudpickle pickles them by value, so executors need neither an
    installed copy nor any file shipped from a local folder.
    """
    import docquill
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(docquill)
