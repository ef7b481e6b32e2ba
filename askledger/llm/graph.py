"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node but the centres has one edge, and that to a centre."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e"))
    odd = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in `edges` (columns a, b) but the smallest ones themselves.

    Each round needs groupings and joins by id over narrow rows only; a hub's rows are spread by the join's own skew
    handling. A round's edges are checkpointed in the shared folder. Edges with a null end and loops are ignored.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while not _all_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
