"""Approximate nearest neighbours by cross-polytope hashing, with exact distances.

Three rounds of random signs and a fast Hadamard transform rotate every unit vector, anew in each of `TABLES` tables; its
bucket is the nearest signed axis. A query probes, in each table, the `PROBES` axes it is nearest to. Within a bucket,
queries meet vectors in blocks of bounded size: distances of the original vectors in double precision, the `k` best of
each block. No pair is ever a row; a query sends on k rows for each probe and block, of which the best k stay.
Queries that met fewer than k vectors are compared with all vectors, in the same kind of blocks.

Of equal vectors only the k + 1 smallest ids are indexed, which loses nothing: ties go to the smaller id. Buckets of any
size are split into as many blocks as they need.

Defined results: vectors that are null, zero, hold null, NaN or infinite components, or have not the usual number of
components (the most frequent one, the larger of equals) take no part, neither as queries; neither do rows with a null
id. Rows that share id and vector count once. With fewer than k candidates there are all of them; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askledger.llm.common import stored

TABLES = 6
PROBES = 16
BLOCK = 2048
QUERY_BLOCK = 512
SEED = 20_000


def transform(x: np.ndarray) -> np.ndarray:
    """Hadamard transform of every row; the number of columns is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(-1, n // (2 * step), 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(-1, n)
        step *= 2
    return x / np.sqrt(n)


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of a table, alike in every process."""
    n = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.pad(unit, ((0, 0), (0, n - unit.shape[1])))
    for signs in np.random.default_rng(SEED + table).choice([-1.0, 1.0], (3, n)):
        x = transform(x * signs)
    return x


def nearest_axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first."""
    y = rotated(unit, table)
    both = np.concatenate((y, -y), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, both.shape[1])]


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _hashed(dimension: int, tables: int, probes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(1), dimension)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for t in range(tables):
                axes = nearest_axes(unit, t, probes)
                rows = pa.array(np.repeat(np.arange(len(x)), axes.shape[1]))
                yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.full(axes.size, t, np.int32)), pa.array(axes.reshape(-1).astype(np.int32))], ["id", "v", "table", "bucket"])

    return task


def _nearest(dimension: int, k: int):
    def task(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _vectors(vectors.column("v").combine_chunks(), dimension)[order]
            asked = _vectors(queries.column("v").combine_chunks(), dimension)
            for q, y in zip(queries.column("id").to_pylist(), asked, strict=True):
                far = ((x - y) ** 2).sum(axis=1)
                far[ids == q] = np.inf
                near = np.arange(len(far)) if len(far) <= k else np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
                near = near[np.argsort(far[near], kind="stable")][:k]
                near = near[np.isfinite(far[near])]
                found.append((np.full(len(near), q), ids[near], np.sqrt(far[near])))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return task


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query among all other vectors."""
    v = F.col(vector_column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = vectors.where(v.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    sizes = usable.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = usable.where(F.size(v) == sizes["n"]).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("asks"))
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    indexed = rows.select("id", "v").distinct().withColumn("n", first).where(F.col("n") <= k + 1).select("id", "v")
    hashed = "id long, v array<double>, table int, bucket int"
    index = stored(indexed.mapInArrow(_hashed(sizes["n"], tables, 1), hashed), "index")
    asked = stored(rows.where("asks").select("id", "v").distinct().mapInArrow(_hashed(sizes["n"], tables, probes), hashed), "probes")
    blocks = index.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    lots = asked.groupBy("table", "bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
    parts = blocks.join(lots, ["table", "bucket"])
    part_of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    part, every = lambda n: part_of(F.col(n)), lambda n: every_of(F.col(n))
    key = ["table", "bucket", "block", "lot"]
    left = index.join(parts, ["table", "bucket"]).select("table", "bucket", part("nb").alias("block"), every("nq").alias("lot"), "id", "v")
    right = asked.join(parts, ["table", "bucket"]).select("table", "bucket", every("nb").alias("block"), part("nq").alias("lot"), "id", "v")
    pair = "query_id long, vec_id long, score double"
    near = stored(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(sizes["n"], k), pair).distinct(), "near")
    full = near.groupBy("query_id").agg(F.count("*").alias("met")).where(F.col("met") >= k).select(F.col("query_id").alias("id"))
    short = stored(rows.where("asks").select("id", "v").distinct().join(full, "id", "left_anti"), "short")
    n = short.count()
    if n:
        nb, nq = (F.lit(-(-x // size)) for x, size in ((index.where("table = 0").count(), BLOCK), (n, QUERY_BLOCK)))
        left = index.where("table = 0").select(part_of(nb).alias("block"), every_of(nq).alias("lot"), "id", "v")
        right = short.select(every_of(nb).alias("block"), part_of(nq).alias("lot"), "id", "v")
        near = near.union(left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInArrow(_nearest(sizes["n"], k), pair))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
