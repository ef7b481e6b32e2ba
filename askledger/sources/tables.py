"""Small side inputs, exports and the analysis tables on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.operators import defects, masking

GROUPS_SCHEMA = "template string, archetype string"


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """The hand-kept template -> archetype list. No file is an empty list; the last of repeated rows wins."""
    try:
        rows = spark.read.csv(path, header=True, enforceSchema=False, quote='"', escape='"', multiLine=True)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], GROUPS_SCHEMA)
        raise
    if not {"template", "archetype"} <= set(rows.columns):
        return spark.createDataFrame([], GROUPS_SCHEMA)
    return (
        rows.select("template", "archetype", F.monotonically_increasing_id().alias("pos"))
        .filter("template <> '' and archetype <> ''")
        .groupBy("template")
        .agg(F.max_by("archetype", "pos").alias("archetype"))
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV directory with a header in each part."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def export_head(
    masked: DataFrame, path: str, n: int = masking.HEAD_EXPORT, include_unmasked: bool = False
) -> DataFrame:
    """Write the head templates in rank order; return (n_written, n_withheld) as one row."""
    head = masking.head_templates(masked, n, include_unmasked)
    # At most n rows by definition, so one ordered file.
    write_csv(head.coalesce(1), path)
    written = masked.sparkSession.read.csv(path, header=True, escape='"', multiLine=True).agg(
        F.count(F.lit(1)).alias("n_written"), F.lit(0).cast("bigint").alias("n_withheld")
    )
    withheld = masking.withheld_count(masked, include_unmasked).select(
        F.lit(0).cast("bigint").alias("n_written"), "n_withheld"
    )
    return written.unionByName(withheld).agg(
        F.sum("n_written").alias("n_written"), F.sum("n_withheld").alias("n_withheld")
    )


def export_defects(found: DataFrame, folder: str) -> list[str]:
    """One CSV directory per defect that occurs; returns their paths."""
    paths = []
    for name, rows in defects.defect_exports(found).items():
        if rows.isEmpty():
            continue
        path = f"{folder}/runs_{name}"
        write_csv(rows.drop("any_dict", "output_id"), path)
        paths.append(path)
    return paths


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table, or only the partitions present in `df` when it is partitioned."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_stages(anomalies: DataFrame, path: str, stages: Sequence[str]) -> None:
    """Replace the rows of the given stages, also by none; rows of other stages already there stay.

    Each stage has a folder of its own, overwritten as a whole: a run that finds nothing leaves nothing behind.
    """
    for stage in stages:
        mine = anomalies.filter(F.col("stage") == stage).drop("stage")
        mine.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/stage={stage}")


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table, if it is there, through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_tables(spark: SparkSession, root: str, names: Sequence[str]) -> Mapping[str, DataFrame]:
    return {name: read_table(spark, f"{root}/{name}") for name in names}
