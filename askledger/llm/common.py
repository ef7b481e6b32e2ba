"""Small helpers of the text operators: inputs, shared storage, batches inside Python tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python task, so that a batch of very long texts stays small.
BATCH_ROWS = 4000
BATCH_BYTES = 16 << 20

_LOCAL: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the batches that Python tasks get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Only a local session may go without; it gets a folder of
    its own, removed at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches, text_column: int, limit: int):
    """Record batches cut so that the texts of each sum to about `limit` bytes at most."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
        for start, stop in blocks(sizes, limit):
            yield batch.slice(start, stop - start)


def blocks(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into runs whose sizes sum to about `limit` at most (a single larger item stands alone)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
