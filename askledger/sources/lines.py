"""Raw lines of the three kinds of source file, with where each came from.

A line is kept whole and decoded leniently: bad bytes are replaced and reported, never fatal.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The sub-directory of each kind, and the file suffix.
KINDS = {"weblog": "logs/jsonl", "input": "input", "output": "output"}
SUFFIX = ".jsonl"

# Archives come before plain files wherever the first of several rows is kept.
RANK_ARCHIVE, RANK_FILE = 0, 1

SCHEMA = (
    "kind string, src_rank int, src_file string, src_line bigint, raw string, is_damaged boolean"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]

_REPLACEMENT = "�"
_REPLACEMENT_ESCAPE = "\\ufffd"


def is_damaged(line: Column) -> Column:
    """Bytes that are no UTF-8, or the mark an earlier lenient decoding left, raw or escaped."""
    # Only a line with such an escape is changed to lower case: that costs more than two looks for one.
    escapes = F.contains(line, F.lit("\\u")) | F.contains(line, F.lit("\\U"))
    return (
        ~F.is_valid_utf8(line)
        | F.contains(line, F.lit(_REPLACEMENT))
        | F.when(escapes, F.contains(F.lower(line), F.lit(_REPLACEMENT_ESCAPE))).otherwise(escapes)
    )


def as_bronze(df: DataFrame, kind: str, rank: int = RANK_FILE) -> DataFrame:
    """Bronze rows from (src_file, src_line, value)."""
    return df.select(
        F.lit(kind).alias("kind"),
        F.lit(rank).alias("src_rank"),
        "src_file",
        F.col("src_line").cast("bigint").alias("src_line"),
        F.make_valid_utf8("value").alias("raw"),
        is_damaged(F.col("value")).alias("is_damaged"),
    )


def text_files(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """Unnumbered lines of the files of one kind; None when the directory does not exist."""
    try:
        files = spark.read.text(f"{root}/{KINDS[kind]}", pathGlobFilter=f"*{SUFFIX}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return files.select(
        F.concat(F.lit(KINDS[kind] + "/"), F.col("_metadata.file_name")).alias("src_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    )


def number_lines(files: DataFrame) -> DataFrame:
    """1-based line numbers per file, without sorting or shuffling the lines.

    A split of a file is read in order by one task, so a line's place in its split is the distance of its
    running id from the split's first. Splits are counted once and their offsets summed per file: that table has
    one row per split, about a millionth of the data; Spark broadcasts it as long as its own threshold allows.
    """
    splits = files.groupBy("src_file", "block").agg(
        F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n_lines")
    )
    earlier = Window.partitionBy("src_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))).drop("n_lines")
    return files.join(offsets, ["src_file", "block"]).select(
        "src_file", (F.col("mid") - F.col("first_mid") + F.col("offset") + 1).alias("src_line"), "value"
    )


def read_lines(spark: SparkSession, root: str, kind: str, archives: bool = True) -> DataFrame:
    """All lines of one kind under `root`: files in the kind's directory and members of *.zip."""
    from askledger.sources.archives import zipped_lines

    parts = []
    if archives:
        parts.append(as_bronze(zipped_lines(spark, root, KINDS[kind]), kind, RANK_ARCHIVE))
    files = text_files(spark, root, kind)
    if files is not None:
        parts.append(as_bronze(number_lines(files), kind))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
