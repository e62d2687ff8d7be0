"""Session helpers.

The library never hard-codes cluster settings.  ``get_session`` is a
convenience for tests, notebooks and ``bench.py``; on a cluster the job's own
session is used as is.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabulon") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("TABULON_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.  Only
    a local-mode session without the setting (tests) gets a scratch folder;
    a cluster session without it is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()  # the setting with a folder of this application
    if current and (not named or current.rstrip("/").startswith(named.rstrip("/"))
                    or current.rstrip("/").startswith("file:" + named.rstrip("/"))):
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="tabulon-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back:
    lineage ends there, and a lost executor costs nothing of what was written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabulon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
