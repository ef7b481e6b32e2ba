"""Loading source files into bronze once each, resumable, with forced redo.

Plain files come through a Structured Streaming file source: its checkpoint remembers the files that were
loaded. A file is always whole inside one micro-batch. A micro-batch replaces the partitions of
exactly the files it holds, so one that is repeated after a failure leaves the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.operators.anomaly import union_all
from askledger.sources import lines as ln
from askledger.sources.archives import zipped_lines
from askledger.sources.tables import drop_table, write_table

FILES_SCHEMA = "kind string, src_file string, n_lines bigint, ingested_at timestamp"


def bronze_path(out: str) -> str:
    return f"{out}/bronze_lines"


def files_path(out: str) -> str:
    return f"{out}/ingested_files"


def read_bronze(spark: SparkSession, out: str, kind: str | None = None) -> DataFrame:
    """The loaded lines, all or of one kind (only that kind's directories are read)."""
    try:
        rows = spark.read.schema(ln.SCHEMA).parquet(bronze_path(out))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ln.SCHEMA)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def ingested_files(spark: SparkSession, out: str) -> DataFrame:
    """Files loaded so far, with their line counts."""
    try:
        return spark.read.schema(FILES_SCHEMA).parquet(files_path(out))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES_SCHEMA)


def write_bronze(bronze: DataFrame, out: str, named: DataFrame | None = None) -> None:
    """Replace the partitions of the files in `bronze`, then note the files as loaded.

    `named` (kind, src_file) lists files that are noted even if they have no line. Lines are counted from what was
    written, so the source is not read again for it. The note comes last: a load cut short in between is done again.
    """
    spark = bronze.sparkSession
    write_table(bronze.select(*ln.COLUMNS), bronze_path(out), ["kind", "src_file"])
    loaded = bronze.select("kind", "src_file").distinct() if named is None else named.distinct()
    lines = read_bronze(spark, out).groupBy("kind", "src_file").agg(F.count(F.lit(1)).alias("n_lines"))
    write_table(
        loaded.join(lines, ["kind", "src_file"], "left").select(
            "kind", "src_file", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
            F.current_timestamp().alias("ingested_at"),
        ),
        files_path(out),
        ["kind", "src_file"],
    )


def _drop_lines(spark: SparkSession, out: str, kind: str, file: str) -> None:
    """Remove the loaded lines of one file."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    drop_table(spark, f"{bronze_path(out)}/kind={escape(kind)}/src_file={escape(file)}")


def _ingest_files(spark: SparkSession, root: str, out: str, checkpoint: str, kind: str, per_batch: int) -> None:
    try:
        stream = (
            spark.readStream.format("text")
            .option("pathGlobFilter", f"*{ln.SUFFIX}")
            .option("maxFilesPerTrigger", per_batch)
            .load(f"{root}/{ln.KINDS[kind]}")
        )
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return
        raise
    placed = stream.select(
        F.concat(F.lit(ln.KINDS[kind] + "/"), F.col("_metadata.file_name")).alias("src_file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )

    def load(batch: DataFrame, _: int) -> None:
        with_ids = batch.withColumn("mid", F.monotonically_increasing_id())
        write_bronze(ln.as_bronze(ln.number_lines(with_ids), kind), out)

    query = (
        placed.writeStream.foreachBatch(load)
        .option("checkpointLocation", f"{checkpoint}/{kind}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _ingest_archives(spark: SparkSession, root: str, out: str, kind: str) -> None:
    # Names only, as many as the archives have members; the data source lists them on the driver anyway.
    done = ingested_files(spark, out).filter((F.col("kind") == kind) & F.contains("src_file", F.lit(".zip!")))
    skip = json.dumps([r.src_file for r in done.select("src_file").toLocalIterator()])
    rows = ln.as_bronze(zipped_lines(spark, root, ln.KINDS[kind], skip), kind, ln.RANK_ARCHIVE)
    if not rows.isEmpty():
        write_bronze(rows, out)


def ingest_available(
    spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = 1000, archives: bool = True
) -> DataFrame:
    """Load every file not loaded yet; returns files seen now and how many were done before. One row."""
    before = ingested_files(spark, out).agg(F.count(F.lit(1)).alias("skipped")).first()["skipped"]
    for kind in ln.KINDS:
        if archives:
            _ingest_archives(spark, root, out, kind)
        _ingest_files(spark, root, out, checkpoint, kind, files_per_batch)
    return ingested_files(spark, out).agg(
        F.count(F.lit(1)).alias("seen"), F.lit(before).cast("bigint").alias("skipped")
    )


def redo_files(spark: SparkSession, root: str, out: str, files: Sequence[str]) -> None:
    """Load the given files again, whatever the checkpoint says. Other files keep their rows.

    The old lines go first, so a file that is empty now has none; it is noted with 0 lines.

    Only bronze is replaced. The typed tables are computed from it, so calls of another file that
    hang off a run of this one cannot be lost.
    """
    for kind, folder in ln.KINDS.items():
        mine = [f for f in files if f.startswith(folder + "/")]
        if mine:
            for file in mine:
                _drop_lines(spark, out, kind, file)
            text = spark.read.text([f"{root}/{f}" for f in mine])
            placed = text.select(
                F.concat(F.lit(folder + "/"), F.col("_metadata.file_name")).alias("src_file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("mid"),
                "value",
            )
            named = spark.createDataFrame([(kind, f) for f in mine], "kind string, src_file string")
            write_bronze(ln.as_bronze(ln.number_lines(placed), kind), out, named)
        members = [f for f in files if ".zip!" in f]
        if members:
            rows = zipped_lines(spark, root, folder).filter(F.col("src_file").isin(members))
            if not rows.isEmpty():
                write_bronze(ln.as_bronze(rows, kind, ln.RANK_ARCHIVE), out)


def ingest_batch(spark: SparkSession, root: str, out: str) -> None:
    """The same load without a checkpoint: everything not in ingested_files, in one batch."""
    rows = union_all([ln.read_lines(spark, root, kind) for kind in ln.KINDS])
    done = ingested_files(spark, out).select("kind", "src_file")
    fresh = rows.join(done, ["kind", "src_file"], "left_anti")
    if not fresh.isEmpty():
        write_bronze(fresh, out)
