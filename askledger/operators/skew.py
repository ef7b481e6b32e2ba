"""Joins and rankings that keep working when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is worth splitting only from this many rows on; it is cut into pieces of about that size.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with at least `min_rows` rows, and into how many pieces to cut it."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= min_rows)
        .select(*keys, (F.ceil(F.col("_rows") / F.lit(min_rows)) + 1).cast("int").alias("_pieces"))
    )


def spread_join(
    big: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join a possibly skewed `big` to `side`, cutting each hot key into pieces of about `min_rows` rows.

    Only the rows of `side` that belong to a hot key are repeated, once for each piece. The list of hot keys has
    one row per `min_rows` rows of `big` at most, so it is broadcast; otherwise both sides would be shuffled by the key to
    meet it, and once more by key and piece.
    Rows spread by a hash of `spread_by` (all columns of `big` by default), which a retried task computes again
    identically.
    """
    hot = F.broadcast(hot_keys(big, keys, min_rows))
    spread = [F.col(c) for c in (spread_by or big.columns)]
    left = big.join(hot, list(keys), "left").withColumn(
        "_salt",
        F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_pieces")).cast("int")).otherwise(0),
    )
    right = side.join(hot, list(keys), "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_pieces").isNotNull(), F.sequence(F.lit(0), F.col("_pieces") - 1)).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return left.drop("_pieces").join(right.drop("_pieces"), [*keys, "_salt"], how).drop("_salt")


def numbered(
    df: DataFrame,
    group: Sequence[str],
    along: str,
    order: Sequence[Column | str],
    width: int = 100_000,
    name: str = "rn",
) -> DataFrame:
    """row_number() inside `group`, without bringing a whole group into one task.

    `along` is a numeric column that leads the order. Rows are cut into ranges of `width`
    along it, numbered inside their range, and shifted by the row count of earlier ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.coalesce(F.col(along), F.lit(0)) / F.lit(width)))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(inside)).alias("l")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_range"]]
    joined = local.join(shifts.alias("s"), on, "inner")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._local") + F.col("s._shift")).cast("bigint").alias(name),
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in `order`.

    Spark cuts every group to one row per task before the shuffle, so a hot key moves little.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
