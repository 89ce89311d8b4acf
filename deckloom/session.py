"""Session for tests and the bench. On a cluster the session comes from spark-submit."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.files.maxPartitionBytes": "8388608",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Generated methods above the JVM's own limit for compiling (8,000 bytes of bytecode) run interpreted,
# which is several times slower than leaving whole-stage code generation for that stage.
# Rows that hold whole images go to Python in batches of so many bytes (one row at least): Spark's 64 MB are held several times over
# on their way, by every task of an executor.
RUNTIME_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def tune(spark: SparkSession) -> None:
    """Settings a running session can still take; the queries need them for speed, for memory and for UTC."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)


def local_session(app: str = "deckloom", cores: str = "8", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests) is a temporary folder made. On a cluster
    an unset folder is an error: a machine-local path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.environ.get("DECKLOOM_TEST_DIR") or tempfile.mkdtemp(prefix="deckloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
