"""Written intermediate tables: parsed once, read by column, safe when executors are lost."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    A session on one machine may leave it unset and gets a folder of its own, removed at exit; any other session must
    set it, because a folder that each executor has for itself loses rows.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="askledger-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def staged(df: DataFrame) -> DataFrame:
    """Write `df` to a new table under the staging folder and read it back.

    For expensive rows that several branches of a plan read: without it each branch would compute them again.
    """
    path = f"{staging_root(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that nothing holds any more. It does so when the driver collects
    garbage, which a driver with memory to spare puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
