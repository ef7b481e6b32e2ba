"""Deal documents into shards by best-fit-decreasing bin packing of indivisible groups (documents with equal texts).

Groups in order of falling size enter the shard with the tightest remaining capacity that holds them. Where they go depends
on sizes alone, so Spark reduces all groups to counts by size, the packing works on those, and Spark then ranks the groups
of each size and looks their shards up. Groups of one size are placed together: the tightest shard stays the tightest until
no further one fits, and equal shards that come next are taken as one run. Shards are kept in a balanced search tree (a
treap) of runs ordered by remaining capacity.

Sizes up to 8,192 count exactly, larger ones rounded up to 13 significant bits, so there are at most 2^13 + 2^12 * 50 of
them whatever the input; that table of sizes is all that reaches the driver. Rounding costs a shard at most 0.025 % of its
capacity.

With a fixed capacity the number of shards is what the packing needs. With a fixed number of shards the capacity is the
least, within `TOLERANCE`, that packs all groups; a group larger than an even share of what larger ones leave gets a shard of
its own and the others share the rest.

Groups of one size are ranked in pieces of about a million. Groups with more than one row in `HEAVY_SHARE` are so few that
their places are broadcast; rows of all others meet theirs in a join whose keys are therefore never hot. Slots are counted
by the input partition that a row came from. Row numbers are stored with the rows, so that tasks run again see the same.

Defined results: a null text counts as empty (size 1, checksum 0) and both are one group; null and repeated ids are carried
along, each row with a slot of its own; an empty table gives no rows; other columns are ignored; ties between equal sizes
go by a hash of the text. A group larger than a fixed capacity is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askledger.llm.common import stored
from askledger.operators.skew import numbered

SHARDS = 8
SIGNIFICANT = 13
RANKED = 1_000_000
HEAVY_SHARE = 2_000
TOLERANCE = 1e-4

#: first rank, rank after the last, first shard, groups in each shard
Stretch = tuple[int, int, int, int]


def size_class(size: Column) -> Column:
    """The size itself if small, else rounded up to `SIGNIFICANT` binary digits."""
    spare = F.greatest(F.length(F.bin(size)) - SIGNIFICANT, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), spare)
    return F.ceil(size / step).cast("long") * step


class Runs:
    """Equal shards in runs (remaining capacity, first shard, how many), in a treap ordered by capacity, then shard."""

    def __init__(self):
        self.root = None

    def add(self, remaining: int, first: int, n: int) -> None:
        key = (remaining, first)
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, n, hash((first, remaining)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF, None, None]), high)

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Take out the run with the least remaining capacity that holds `size`."""
        low, high = self._split(self.root, (size, -1))
        node, above = high, None
        while node and node[3]:
            node, above = node[3], node
        if node is None:
            self.root = low
            return None
        if above is None:
            high = node[4]
        else:
            above[3] = node[4]
        self.root = self._merge(low, high)
        return (*node[0], node[1])

    @classmethod
    def _split(cls, node, key):
        """Runs before `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[4], high = cls._split(node[4], key)
            return node, high
        low, node[3] = cls._split(node[3], key)
        return low, node

    @classmethod
    def _merge(cls, a, b):
        if a is None or b is None:
            return a or b
        if a[2] > b[2]:
            a[4] = cls._merge(a[4], b)
            return a
        b[3] = cls._merge(a, b[3])
        return b


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[dict[int, list[Stretch]], int] | None:
    """Where the groups of each size go, and the number of shards; None if `most` shards do not hold them.

    `sizes` are (size, number of groups), sizes falling; none is over the capacity.
    """
    runs, shards, places = Runs(), 0, {}
    for size, n in sizes:
        rank, stretches = 0, []
        while rank < n:
            found = runs.tightest(size)
            if found is None:
                fresh = math.ceil((n - rank) / (capacity // size))
                if most is not None and shards + fresh > most:
                    if shards == most:
                        return None
                    fresh = most - shards
                found = (capacity, shards, fresh)
                shards += fresh
            remaining, first, count = found
            each = remaining // size
            full, over = divmod(min(n - rank, each * count), each)
            stretches.append((rank, rank + full * each + over, first, each))
            rank += full * each + over
            for left, start, some in ((remaining - each * size, first, full), (remaining - over * size, first + full, min(over, 1)), (remaining, first + full + min(over, 1), count - full - min(over, 1))):
                if some:
                    runs.add(left, start, some)
        places[size] = stretches
    return places, shards


def balanced(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[Stretch]]:
    """Where the groups of each size go if there are `shards` shards, as even as the packing makes them."""
    left, own, places, rest = sum(s * n for s, n in sizes), 0, {}, []
    for size, n in sizes:
        alone = 0
        while alone < n and own < shards - 1 and size * (shards - own) > left:
            alone, own, left = alone + 1, own + 1, left - size
        if alone:
            places[size] = [(0, alone, own - alone, 1)]
        if alone < n:
            rest.append((size, n - alone))
    if not rest:
        return places
    bins = shards - own
    low = max(math.ceil(left / bins), rest[0][0])
    packed, high = best_fit(rest, low, bins), low + rest[0][0]
    if packed is None:  # so much is always enough: no shard is left with less room than the largest group
        packed = best_fit(rest, high, bins)
        while high - low > max(1, TOLERANCE * low):
            middle = (low + high) // 2
            tried = best_fit(rest, middle, bins)
            low, high, packed = (middle, high, packed) if tried is None else (low, middle, tried)
    for size, stretches in packed[0].items():
        alone = places.get(size, [])
        skip = alone[-1][1] if alone else 0
        places[size] = alone + [(a + skip, z + skip, first + own, each) for a, z, first, each in stretches]
    return places


def _placed(groups: DataFrame, places: dict[int, list[Stretch]], counts: dict[int, int]) -> DataFrame:
    """digest, rows, shard for every group (digest, class, rows)."""
    spark = groups.sparkSession
    schema = "class long, pieces int, stretches array<struct<begin:long,end:long,first:long,each:long>>"
    plan = spark.createDataFrame([(size, math.ceil(counts[size] / RANKED), stretches) for size, stretches in places.items()], schema)
    salted = groups.join(F.broadcast(plan), "class").withColumn("piece", F.pmod(F.xxhash64("digest"), "pieces"))
    before = Window.partitionBy("class").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("class", "piece").count().select("class", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("class", "piece").orderBy("digest"))
    ranked = salted.withColumn("k", inside).join(shifts, ["class", "piece"]).withColumn("rank", F.col("k") - 1 + F.col("shift"))
    at = F.filter("stretches", lambda s: F.col("rank") < s["end"])[0]
    return ranked.select("digest", "rows", (at["first"] + F.floor((F.col("rank") - at["begin"]) / at["each"])).cast("int").alias("shard"))


def shard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row: `shards` even shards, or as few as hold `capacity` bytes each."""
    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"),
        ),
        "sizes",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = stored(groups.select("digest", "rows", size_class(F.col("bytes")).alias("class")), "groups")
    sizes = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).orderBy(F.desc("class")).collect()
    counts = {r["class"]: r["n"] for r in sizes}
    if capacity is None:
        places = balanced(list(counts.items()), shards)
    elif sizes and sizes[0]["class"] > capacity:
        raise ValueError("a group is larger than the capacity of a shard")
    else:
        places, _ = best_fit(counts.items(), capacity)
    heavy_rows = max(2, math.ceil(sum(r["rows"] for r in sizes) / HEAVY_SHARE))
    placed = stored(_placed(groups, places, counts), "places")
    heavy = placed.where(F.col("rows") >= heavy_rows).drop("rows")
    many = rows.join(F.broadcast(heavy), "digest")
    few = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(placed.where(F.col("rows") < heavy_rows).drop("rows"), "digest")
    columns = ["row", "doc_id", "size", "text_crc32", "shard"]
    dealt = stored(many.select(*columns).unionByName(few.select(*columns)), "shards")
    # a row number holds its partition above bit 33: counted by partition, no shard is gathered anywhere
    slotted = numbered(dealt, ["shard"], "row", ["row"], width=1 << 33, name="slot")
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def digest(sharded: DataFrame) -> DataFrame:
    """The columns of the query: its law is that of even bytes."""
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
