"""SparkSession construction and cluster-aware settings."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library should carry. AQE re-plans joins from runtime sizes
# (a join side is broadcast only when its measured size is under the threshold) and splits
# skewed shuffle partitions; the session time zone is UTC as in the reference's jobs.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "volforge", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session. ``master`` and ``shuffle_partitions`` are for local runs and
    tests; on a cluster leave them ``None`` so the cluster's own settings apply."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the executor; give it room (ignored once a JVM is running)
        conf["spark.driver.memory"] = os.environ.get("VOLFORGE_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session, whose
    tasks all run on this machine, may fall back to a folder of its own; elsewhere it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or fallback or os.environ.get("VOLFORGE_CHECKPOINT_DIR")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="volforge-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cpu_partitions(spark: SparkSession, factor: int = 2) -> int:
    """Partition count for CPU-bound stages over few rows (fits, path chunks). An explicit count
    keeps AQE from coalescing them into one task because their *bytes* are small."""
    return max(1, int(spark.sparkContext.defaultParallelism) * factor)
