"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the session is created by the platform; we only *read* its
``spark.checkpoint.dir`` (a shared folder).  A private folder is configured only
when the session has none, which is the case in unit tests.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LINKWEAVE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder, configuring one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # A private folder would be a different disk on every executor.
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="linkweave-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of frames that are no longer held.

    It learns of them from the driver's collector, which an idle driver hardly runs.
    """
    gc.collect(0)
    spark.sparkContext._jvm.System.gc()
