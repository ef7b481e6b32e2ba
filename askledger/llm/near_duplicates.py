"""Near-duplicate documents by HyperMinHash signatures, candidate bands and exact checks on full shingle sets.

1. One pass turns every text into its set size, a 128-bit digest of the set and the keys of 51 bands of five compressed
   registers. Texts with equal sets form a class; only a class's smallest id goes on, so copies cost one narrow row each.
2. Documents that share a band's key share a bucket. A bucket links its smallest id with each other member: as many
   pairs as members. Pairs are first estimated from the registers (corrected for accidental collisions), those at
   `LEAST_ESTIMATE` or more are checked on the full sets.
3. Components of the confirmed links. What a star can miss is a link between members of one bucket that are still in
   different components. Such components gather in camps: each follows the heaviest component that it meets in a bucket,
   and in turn the one that that follows.
   Camps that meet in a bucket (and the followers of one camp among themselves) are compared completely, but not a
   component with itself: in blocks of bounded size, registers first and then full sets. A block reports at most one
   link for each component in it, never pairs.
4. Components again, over components.

A pair at the threshold is missed with probability (1 - 0.75^5)^51, about one in a million, smaller for closer pairs.
Linked: 100 * shared >= 75 * union of distinct five-word shingles.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; fewer than five words make
one shingle. Rows that share an id are one vertex with the links of all its texts. A row with a null id takes the
component of its copies; without any it has none and is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askledger.llm import signatures as sig
from askledger.llm.common import blocks, shared_folder, stored
from askledger.llm.graph import components
from askledger.llm.words import WordHashes

PERCENT = 75
LEAST_ESTIMATE = 0.62
#: Shingles of one side of a block comparison.
BLOCK_SHINGLES = 1 << 18
JUMPS = 2


def shingle_sets(texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    words, counts = hashes.of(texts)
    ends = np.cumsum(counts)
    return [sig.shingle_set(words[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def linked(shared: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (size_a + size_b - shared)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        for start, stop in blocks([1] * b.num_rows, 1000):
            part = b.slice(start, stop - start)
            sets = shingle_sets(part.column(1).to_pylist(), hashes)
            marks = [sig.digest(s) for s in sets]
            keys = sig.band_keys(sig.registers(sets))
            offsets = np.arange(0, keys.size + 1, sig.BANDS, dtype=np.int32)
            yield pa.record_batch(
                [
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                ],
                ["id", "n", "s1", "s2", "bands"],
            )


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        for start, stop in blocks([len(t) for t in b.column(1).to_pylist()], 4 << 20):
            part = b.slice(start, stop - start)
            sets = shingle_sets(part.column(1).to_pylist(), hashes)
            regs = sig.registers(sets)
            yield pa.record_batch(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["id", "n", "regs", "shingles"],
            )


def _registers_of(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), sig.BUCKETS)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidate pairs with both signatures and sets, the linked ones."""
    for b in batches:
        col = {name: b.column(k).to_pylist() for k, name in enumerate(b.schema.names)}
        if not b.num_rows:
            continue
        na, nb = np.array(col["n_a"]), np.array(col["n_b"])
        near = sig.estimated_jaccard(_registers_of(col["regs_a"]), _registers_of(col["regs_b"]), na, nb) >= LEAST_ESTIMATE
        found = []
        for k in np.flatnonzero(near):
            x, y = (np.frombuffer(col[c][k], np.uint64) for c in ("shingles_a", "shingles_b"))
            if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                found.append(k)
        yield pa.record_batch([b.column(0).take(pa.array(found, pa.int64())), b.column(1).take(pa.array(found, pa.int64()))], ["a", "b"])


def _between(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between documents of two blocks that lie in different components; a spanning set of them is enough."""
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        ids, comps = right.column("id").to_numpy(), right.column("comp").to_numpy()
        sizes, regs = right.column("n").to_numpy(), _registers_of(right.column("regs").to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in right.column("shingles").to_pylist()]
        own = {c: left.column(c).to_pylist() for c in ("id", "comp", "n", "shingles", "same")}
        mine = _registers_of(left.column("regs").to_pylist())
        names, root = np.unique(np.concatenate((comps, np.array(own["comp"], np.int64))), return_inverse=True)
        there, here = root[: len(comps)], root[len(comps) :]
        joined = np.arange(len(names))  # the smallest component each one is known to reach
        for k in range(left.num_rows):
            n, one = own["n"][k], np.frombuffer(own["shingles"][k], np.uint64)
            open_ = (joined[there] != joined[here[k]]) & (100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n))
            if own["same"][k]:  # both of one camp: each pair once
                open_ &= ids > own["id"][k]
            near = np.flatnonzero(open_)
            if len(near):
                estimate = sig.estimated_jaccard(mine[k][None, :], regs[near], n, sizes[near])
                near = near[estimate >= LEAST_ESTIMATE]
            for j in near:
                a, b = joined[here[k]], joined[there[j]]
                if a != b and linked(len(np.intersect1d(one, sets[j], assume_unique=True)), n, sizes[j]):
                    found.append((int(names[a]), int(names[b])))
                    joined[joined == max(a, b)] = min(a, b)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = stored(texts.mapInArrow(_signed, "id long, n long, s1 long, s2 long, bands array<long>"), "signed")

    classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    reps = signed.join(classes, ["s1", "s2"]).where("id = rep")
    bands = stored(reps.select("id", F.explode("bands").alias("key")), "bands")
    shared = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead != last").drop("last")
    members = stored(bands.join(shared, "key").distinct(), "members")

    met = members.select("id").distinct()
    sets = stored(texts.where("text IS NOT NULL").join(met, "id").select("id", "text").mapInArrow(_full, "id long, n long, regs binary, shingles binary"), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"{c}_{name}") for c in sets.columns])

    star = members.where("id != lead").select("lead", "id").distinct()
    both = star.join(side("a"), F.col("lead") == F.col("id_a")).join(side("b"), F.col("id") == F.col("id_b"))
    links = both.select("id_a", "id_b", "n_a", "n_b", "regs_a", "regs_b", "shingles_a", "shingles_b").mapInArrow(_confirmed, "a long, b long")
    first = stored(components(links), "components")

    within = met.join(first, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    meeting = members.join(within, "id").select("key", "comp").distinct()
    mixed = meeting.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    meeting = meeting.join(mixed, "key")
    weights = within.join(sets.select("id", "n"), "id").groupBy("comp").agg(F.sum("n").alias("weight"))
    weighed = meeting.join(weights, "comp")
    heaviest = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("comp")).alias("minus"))).alias("top"))
    anchors = weighed.join(heaviest, "key").groupBy("comp").agg((-F.max("top")["minus"]).alias("anchor"))
    for _ in range(JUMPS):  # follow the one that one's anchor follows: chains of small components end in one camp
        further = anchors.select(F.col("comp").alias("anchor"), F.col("anchor").alias("next"))
        anchors = anchors.join(further, "anchor").select("comp", F.col("next").alias("anchor"))
    anchors = stored(anchors.select("comp", F.struct("anchor", (F.col("comp") == F.col("anchor")).alias("core")).alias("camp")), "camps")

    full = within.join(anchors, "comp").join(sets, "id").select("id", "comp", "camp", "n", "regs", "shingles")
    weight = full.groupBy("camp").agg(F.sum("n").alias("w"))
    met_in = meeting.join(anchors, "comp").select("key", "camp").distinct()
    pairs = (
        met_in.withColumnRenamed("camp", "x").join(met_in.withColumnRenamed("camp", "y"), "key")
        .where("x < y OR x = y AND NOT x.core").select("x", "y").distinct()
        .join(weight.toDF("x", "wx"), "x").join(weight.toDF("y", "wy"), "y")
    )
    # The heavier camp of a pair is the host. A host's guests come together, so that its documents move once.
    first_hosts = F.col("wx") >= F.col("wy")
    hosted = stored(
        pairs.select(F.when(first_hosts, F.col("x")).otherwise(F.col("y")).alias("host"), F.when(first_hosts, F.col("y")).otherwise(F.col("x")).alias("guest"), F.greatest("wx", "wy").alias("wh"), F.least("wx", "wy").alias("wg")),
        "hosts",
    )
    pieces = lambda w: F.ceil(w / BLOCK_SHINGLES).cast("int")
    parts = hosted.groupBy("host").agg(pieces(F.max("wh")).alias("np"), pieces(F.sum("wg")).alias("nl"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    guests = hosted.select("host", "guest").join(parts, "host").join(full.toDF("id", "comp", "guest", "n", "regs", "shingles"), "guest")
    left = guests.select("host", every("np").alias("part"), part("nl").alias("lot"), F.expr("host = guest").alias("same"), "id", "comp", "n", "regs", "shingles")
    hosts = full.toDF("id", "comp", "host", "n", "regs", "shingles").join(parts, "host")
    right = hosts.select("host", part("np").alias("part"), every("nl").alias("lot"), "id", "comp", "n", "regs", "shingles")
    key = ["host", "part", "lot"]
    between = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_between, "a long, b long")
    second = stored(components(between), "components").toDF("comp", "last")

    joined = within.join(second, "comp", "left").select(F.col("id").alias("rep"), F.coalesce("last", "comp").alias("component"))
    rows = signed.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").join(joined, "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept")
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay when one of each component does, all columns kept."""
    gone = near_duplicates(docs, id_column, text_column).where("NOT kept").select(F.col("doc_id").alias(id_column)).distinct()
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)


#: The same result in SQL: all pairs that share a shingle, and everything reachable. For small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
