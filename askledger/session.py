"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results, not only speed. A job must run with these.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON object may repeat a key; the last value wins instead of the row failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings for speed and for surviving skew; a cluster may override any of them.
ADVISED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A task's memory follows the size of its partition: many small ones to start with, merged up to a fixed size.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # The same for what a task scans.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what the operators need on an existing session and return it."""
    for key, value in {**ADVISED, **REQUIRED}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("askledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**ADVISED, **REQUIRED}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
