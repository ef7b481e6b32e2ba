"""Lines of archive members, as a Spark data source: one partition per member, read as a stream."""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 4096

# The source's classes go to the workers by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Member(InputPartition):
    """One member of one archive."""

    def __init__(self, archive: str, member: str):
        self.archive = archive
        self.member = member


def holds(member: str, subdir: str) -> bool:
    """Is a member of this kind: its directories contain `subdir` whole, or it has none."""
    dirs = PurePosixPath(member).parts[:-1]
    want = PurePosixPath(subdir).parts
    windows = (dirs[i : i + len(want)] for i in range(len(dirs) - len(want) + 1))
    return not dirs or want in windows


def source_name(archive: str, member: str) -> str:
    """How a member is named in provenance columns."""
    return f"{os.path.basename(archive)}!{member}"


class ZippedLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.subdir = options["subdir"]
        self.suffix = options.get("suffix", ".jsonl")
        self.skip = set(json.loads(options.get("skip", "[]")))

    def partitions(self) -> list[Member]:
        # Only the archives' tables of contents are read here.
        found = []
        for archive in sorted(glob.glob(os.path.join(glob.escape(self.root), "*.zip"))):
            with zipfile.ZipFile(archive) as z:
                found += [
                    Member(archive, name)
                    for name in sorted(z.namelist())
                    if name.endswith(self.suffix)
                    and holds(name, self.subdir)
                    and source_name(archive, name) not in self.skip
                ]
        return found or [Member("", "")]

    def read(self, partition: Member) -> Iterator:
        if not partition.archive:
            return
        import pyarrow as pa

        schema = pa.schema(
            [("src_file", pa.string()), ("src_line", pa.int64()), ("value", pa.string())]
        )
        name = source_name(partition.archive, partition.member)

        def batch(first: int, lines: list[str]) -> pa.RecordBatch:
            numbers = range(first, first + len(lines))
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(lines)), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())],
                schema=schema,
            )

        with zipfile.ZipFile(partition.archive) as z, z.open(partition.member) as raw:
            lines, first, size = [], 1, 0
            for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
                lines.append(line.rstrip("\r\n"))
                size += len(line)
                # Long lines fill a batch by size, short ones by count.
                if len(lines) == BATCH or size > 8 << 20:
                    yield batch(first, lines)
                    first, lines, size = first + len(lines), [], 0
            if lines:
                yield batch(first, lines)


class ZippedLines(DataSource):
    """format("zipped_lines"): path = directory of archives, subdir = directory inside them."""

    SCHEMA = "src_file string, src_line bigint, value string"

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> ZippedLinesReader:
        return ZippedLinesReader(self.options)


def zipped_lines(spark: SparkSession, root: str, subdir: str, skip: str = "[]") -> DataFrame:
    """Lines of the archives in a directory that every executor can read as a local path.

    `skip` is a JSON list of provenance names to leave out. Without any archive no Python source is started.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*.zip")
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(
        where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    ):
        return spark.createDataFrame([], ZippedLines.SCHEMA)
    spark.dataSource.register(ZippedLines)
    reader = spark.read.format("zipped_lines").option("subdir", subdir).option("skip", skip)
    return reader.load(root.removeprefix("file://"))
