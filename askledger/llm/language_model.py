"""A bigram language model whose counts live in a log-frequency Bloom filter.

Building. Every task counts the n-grams of its texts and sends them, as sorted hash lists, to the segments of the filter
that own those hashes. A segment sums the lists of all tasks and sets its bits: an n-gram with count c is inserted once
for each level 1 .. 1 + floor(log2 c). Segments are as many as the corpus needs for each to fit in one task, and each has
`BITS` to 2 `BITS` bits for every insertion, so at most 1 - exp(-2 / BITS) = 11.8 % of its bits are set and an n-gram that
was never seen passes a level with probability 1.4 % at most, whatever the size of the corpus. Inside a segment n-grams
are told apart by 32 bits, which adds less than 0.2 % (`SEGMENT_BYTES` of text hold under 2^23 n-grams). The segments stay
a table; nothing that grows with the corpus is collected or broadcast.

Scoring. Texts are read in slices. A slice sends its distinct n-grams to their segments, which probe levels 1, 2, ...
until one is missing, and the levels come back to the slice; level q stands for a count of about 1.5 * 2^(q-1).
With those counts c~,

    p(w | v) = 0.6 * min(1, c~(v w) / c~(v)) + 0.4 * (c~(w) + 0.1) / (N + 0.1 (V + 1))

and the model's score is the sum of log10 p over a text's words and its end. The base score uses exact counts: at most
`FREQUENT` tokens, those over a power of two, are broadcast; all rarer ones are joined by hash.

Tokens are held as 64-bit hashes. Defined results: a null text is empty, so it has the end as its one token; rows with a
null id are scored but never learned from and count as held out; repeated rows count each; with nothing to learn from,
every token is unknown; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.llm.common import sliced, stored
from askledger.llm.words import WordHashes, mixed

BITS = 16
SEGMENT_BYTES = 8 << 20
FREQUENT = 1 << 20
#: Bytes of text that a task counts or scores at a time.
COUNT_BYTES, SCORE_BYTES = 8 << 20, 8 << 20
PROBES = 2
WEIGHT = 0.6
ADDED = 0.1

_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_ONE, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def tokens_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each text, the token before each, and where each text's tokens end."""
    ends = np.cumsum(counts + 1)
    tokens = np.insert(words, np.cumsum(counts), _END)
    before = np.concatenate(([_START], tokens[:-1])).astype(np.uint64)
    if len(ends):
        before[np.concatenate(([0], ends[:-1]))] = _START
    return tokens, before[: len(tokens)], ends


def one_gram(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens + _ONE)


def two_gram(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * _PAIR + tokens)


@dataclass
class Filter:
    """Bits in segments; the top bits of a hash choose the segment, the others the places in it."""

    bits: np.ndarray
    segment_bits: int
    segments: int

    @staticmethod
    def places(hashes: np.ndarray, level: int, segment_bits: int) -> Iterator[np.ndarray]:
        """Places inside the segment, one array for each probe."""
        first, step = mixed(hashes ^ _ONE), mixed(hashes ^ _PAIR) | np.uint64(1)
        for k in range(PROBES):
            with np.errstate(over="ignore"):
                yield (first + np.uint64(level * PROBES + k) * step) >> np.uint64(64 - (segment_bits.bit_length() - 1))

    @staticmethod
    def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
        return hashes >> np.uint64(64 - (segments.bit_length() - 1))

    @staticmethod
    def local(hashes: np.ndarray, segments: int) -> np.ndarray:
        """The 32 bits after those that choose the segment."""
        return ((hashes << np.uint64(segments.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def of_counts(cls, local: np.ndarray, counts: np.ndarray) -> Filter:
        """One segment that holds these n-grams, sized by its insertions."""
        level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
        bits = 1 << max(6, (BITS * int(level.sum()) - 1).bit_length())
        there, grams = np.zeros(bits, bool), local.astype(np.uint64)
        for k in range(1, int(level.max(initial=0)) + 1):
            for place in cls.places(grams[level >= k], k, bits):
                there[place] = True
        return cls(np.packbits(there, bitorder="little"), bits, 1)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """How many levels of each n-gram are present."""
        found = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        at = self.segment_of(hashes, self.segments) * np.uint64(self.segment_bits) if self.segments > 1 else np.zeros(len(hashes), np.uint64)
        for level in range(1, 65):
            there = np.ones(len(alive), bool)
            for place in self.places(hashes[alive], level, self.segment_bits):
                p = at[alive] + place
                there &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[there]
            if not len(alive):
                break
            found[alive] = level
        return found


def counts_of(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for."""
    return np.where(levels <= 1, levels, 1.5 * np.exp2(levels - 1))


def _summed(blobs: list[bytes], numbers: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and the sum of their counts over several lists."""
    hashes = np.frombuffer(b"".join(blobs), kind)
    counts = np.frombuffer(b"".join(numbers), np.uint32)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return hashes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


@dataclass
class Model:
    #: segment, bits
    filter: DataFrame | None
    segments: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    total: int
    distinct: int
    rare: DataFrame | None

    def log_probability(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.total + ADDED * (self.distinct + 1)))


def by_segment(grams: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of each n-gram, the order that brings them together, and where each segment begins in it."""
    owner = Filter.segment_of(grams, segments).astype(np.uint16 if segments <= 1 << 16 else np.uint32)
    order = np.argsort(owner, kind="stable")
    return owner, order, np.searchsorted(owner[order], np.arange(segments + 1))


def train(docs: DataFrame, usable: Column, text_column: str = "text") -> Model:
    """Count all texts where `usable` holds; keep counts in a filter, exact token counts beside it in a table."""
    texts = docs.where(usable).select(F.col(text_column).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    segments = 1 << max(4, math.ceil(math.log2(max(1, size / SEGMENT_BYTES))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in sliced(batches, 0, COUNT_BYTES):
            tokens, before, _ = tokens_of(*hashes.of(b.column(0).to_pylist()))
            ones, n = np.unique(tokens, return_counts=True)
            _, order, cut = by_segment(one_gram(ones), segments)
            ones, n = ones[order], n[order].astype(np.uint32)
            pairs, m = np.unique(two_gram(before, tokens), return_counts=True)
            at = np.searchsorted(Filter.segment_of(pairs, segments), np.arange(segments + 1))
            pairs, m = Filter.local(pairs, segments), m.astype(np.uint32)
            own = [s for s in range(segments) if cut[s + 1] > cut[s] or at[s + 1] > at[s]]
            part = lambda x, c: pa.array([x[c[s] : c[s + 1]].tobytes() for s in own], pa.binary())  # noqa: E731, B023
            yield pa.record_batch([pa.array(own, pa.int64()), part(ones, cut), part(n, cut), part(pairs, at), part(m, at)], ["segment", "ones", "n", "pairs", "m"])

    def build(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_pylist()
        tokens, n = _summed(get("ones"), get("n"), np.uint64)
        pairs, m = _summed(get("pairs"), get("m"), np.uint32)
        made = Filter.of_counts(np.concatenate((Filter.local(one_gram(tokens), segments), pairs)), np.concatenate((n, m)))
        one = lambda x, kind: pa.array([x], kind)
        return pa.table(
            {
                "segment": table.column("segment")[:1], "bits": one(made.bits.tobytes(), pa.binary()), "grams": one(len(tokens) + len(pairs), pa.int64()),
                "tokens": one(tokens.view(np.int64).tolist(), pa.list_(pa.int64())), "counts": one(n.tolist(), pa.list_(pa.int64())),
            }
        )

    built = stored(
        texts.mapInArrow(count, "segment long, ones binary, n binary, pairs binary, m binary")
        .groupBy("segment")
        .applyInArrow(build, "segment long, bits binary, grams long, tokens array<long>, counts array<long>"),
        "segments",
    )
    tokens = built.select(F.inline(F.arrays_zip("tokens", "counts"))).toDF("token", "n")
    by_level = tokens.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    least, kept = 1 << 62, 0
    for row in by_level:
        kept += row["tokens"]
        if kept > FREQUENT:
            break
        least = 1 << row["level"]
    top = tokens.where(F.col("n") >= least).toArrow()
    known, n = (top.column(c).to_numpy() for c in ("token", "n"))
    known = known.astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return Model(
        built.select("segment", "bits"), segments, known[order], n[order].astype(np.int64), sum(r["n"] for r in by_level), sum(r["tokens"] for r in by_level), tokens.where(F.col("n") < least)
    )


#: What a slice knows of its documents before the levels are there, and after.
KNOWN = "doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, rest: array<struct<token: long, times: long>>"
SCORED = KNOWN + ", score: double"


ASKED = pa.schema(
    [
        ("slice", pa.int64()), ("segment", pa.int64()), ("ones", pa.binary()), ("pairs", pa.binary()),
        (
            "known",
            pa.list_(
                pa.struct(
                    [
                        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
                        ("rest", pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int64())]))),
                    ]
                )
            ),
        ),
        ("tokens", pa.binary()), ("one_owner", pa.binary()), ("pair_owner", pa.binary()),
    ]
)
ASKED_SQL = f"slice long, segment long, ones binary, pairs binary, known array<struct<{KNOWN}>>, tokens binary, one_owner binary, pair_owner binary"


def pairs_of(which: np.ndarray, starts: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbered tokens, the first of a text following the number `distinct`: the number before, the
    number, and each token's pair."""
    before = np.concatenate(([0], which[:-1]))
    before[starts] = distinct
    keys, pair = np.unique(before * distinct + which, return_inverse=True)
    return keys // distinct, keys % distinct, pair


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def score(docs: DataFrame, held_out: Column, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: token numbers, exact base score and the model's score."""
    spark = docs.sparkSession
    light = Model(None, model.segments, model.frequent, model.frequent_counts, model.total, model.distinct, None)
    shared, segments = spark.sparkContext.broadcast(light), model.segments
    kind = np.uint16 if segments <= 1 << 16 else np.uint32

    def slices(of_slice: Callable) -> Callable:
        """A task that calls `of_slice` on each slice. Texts and questions come from two runs over the same rows, so a
        slice is named by its place and its content: runs that cut the rows differently cannot be mistaken for alike."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, partition = WordHashes(), TaskContext.get().partitionId()
            for k, b in enumerate(sliced(batches, 2, SCORE_BYTES)):
                tokens, _, ends = tokens_of(*hashes.of(b.column(2).to_pylist()))
                name = blake2b(f"{partition} {k} {b.column(0).to_pylist()}".encode() + ends.tobytes() + tokens.tobytes(), digest_size=8)
                number = int.from_bytes(name.digest(), "little", signed=True)
                distinct, which = np.unique(tokens, return_inverse=True)
                yield pa.RecordBatch.from_pylist([{"slice": number, **row} for row in of_slice(b, tokens, ends, distinct, which)], schema=ASKED)

        return task

    def grams_of(ends: np.ndarray, distinct: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after, _ = pairs_of(which, np.concatenate(([0], ends[:-1])), len(distinct))
        return one_gram(distinct), two_gram(np.append(distinct, _START)[before], distinct[after])

    def ask(b: pa.RecordBatch, tokens: np.ndarray, ends: np.ndarray, distinct: np.ndarray, which: np.ndarray) -> Iterator[dict]:
        ones, pairs = grams_of(ends, distinct, which)
        _, one_order, cut = by_segment(ones, segments)
        _, pair_order, pair_cut = by_segment(pairs, segments)
        ones, pairs = Filter.local(ones[one_order], segments), Filter.local(pairs[pair_order], segments)
        for s in np.flatnonzero((cut[1:] > cut[:-1]) | (pair_cut[1:] > pair_cut[:-1])).tolist():
            yield {"segment": s, "ones": ones[cut[s] : cut[s + 1]].tobytes(), "pairs": pairs[pair_cut[s] : pair_cut[s + 1]].tobytes()}

    def keep(b: pa.RecordBatch, tokens: np.ndarray, ends: np.ndarray, distinct: np.ndarray, which: np.ndarray) -> Iterator[dict]:
        m = shared.value
        unknown = len(m.frequent)
        starts = np.concatenate(([0], ends[:-1]))
        at = np.minimum(np.searchsorted(m.frequent, distinct), max(0, unknown - 1))
        found = m.frequent[at] == distinct if unknown else np.zeros(len(distinct), bool)
        base = np.where(found, m.log_probability(m.frequent_counts[at]), 0.0)[which] if unknown else np.zeros(len(tokens))
        here = found[which]
        rest = [None] * len(ends)
        absent = np.flatnonzero(~here)
        owner = np.searchsorted(ends, absent, side="right")
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for k, part in zip(np.unique(owner), np.split(absent, cuts), strict=False):
            values, times = np.unique(tokens[part], return_counts=True)
            rest[k] = [{"token": t, "times": n} for t, n in zip(values.view(np.int64).tolist(), times.tolist(), strict=True)]
        sums = lambda x: np.add.reduceat(x, starts).tolist()
        known = [b.column(0).to_pylist(), b.column(1).to_pylist(), (ends - starts).tolist(), sums(here.astype(np.int64)), sums(base), rest]
        known = [dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base", "rest"), row, strict=True)) for row in zip(*known, strict=True)]
        one_owner, pair_owner = (by_segment(g, segments)[0] for g in grams_of(ends, distinct, which))
        yield {"known": known, "tokens": _packed(which.astype(np.uint32)), "one_owner": _packed(one_owner.astype(kind)), "pair_owner": _packed(pair_owner.astype(kind))}

    def probe(lists: pa.Table, segment: pa.Table) -> pa.Table:
        bits = np.frombuffer(segment.column("bits")[0].as_py(), np.uint8) if segment.num_rows else np.zeros(8, np.uint8)
        f = Filter(bits, len(bits) * 8, 1)
        levels = lambda c: pa.array([f.levels(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64)).astype(np.uint8).tobytes() for x in lists.column(c)], pa.binary())
        return pa.table({"slice": lists.column("slice"), "segment": lists.column("segment"), "ones": levels("ones"), "pairs": levels("pairs")})

    def finish(asked: pa.Table, probed: pa.Table) -> pa.Table:
        if asked.num_rows != 1 or not probed.num_rows:
            raise ValueError("the rows of the input came in another order when read again: write them to a table first")
        m, probed, row = shared.value, probed.sort_by("segment"), asked.to_pylist()[0]

        def counts(column: str, owner: np.ndarray) -> np.ndarray:
            out = np.zeros(len(owner))
            out[np.argsort(owner, kind="stable")] = counts_of(np.frombuffer(b"".join(probed.column(column).to_pylist()), np.uint8).astype(np.int64))
            return out

        known = row["known"]
        ends = np.cumsum([k["n_tokens"] for k in known])
        starts = np.concatenate(([0], ends[:-1]))
        which = _unpacked(row["tokens"], np.uint32).astype(np.int64)
        single = counts("ones", _unpacked(row["one_owner"], kind))
        before, after, pair = pairs_of(which, starts, len(single))
        # a text's start is as frequent as its end
        context = np.append(single, single[which[-1]])[before]
        follows = np.minimum(1.0, counts("pairs", _unpacked(row["pair_owner"], kind)) / np.maximum(context, 1.0))
        p = WEIGHT * follows + (1 - WEIGHT) * 10 ** m.log_probability(single[after])
        for k, value in zip(known, np.add.reduceat(np.log10(p)[pair], starts).tolist(), strict=True):
            k["score"] = value
        return pa.Table.from_pylist(known, schema=pa.schema([*ASKED.field("known").type.value_type, ("score", pa.float64())]))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    lists = rows.mapInArrow(slices(ask), ASKED_SQL).select("slice", "segment", "ones", "pairs")
    probed = lists.groupBy("segment").cogroup(model.filter.groupBy("segment")).applyInArrow(probe, "slice long, segment long, ones binary, pairs binary")
    texts = rows.mapInArrow(slices(keep), ASKED_SQL).select("slice", "known", "tokens", "one_owner", "pair_owner")
    scored = texts.groupBy("slice").cogroup(probed.groupBy("slice")).applyInArrow(finish, SCORED)
    done = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    scale = F.lit(model.total + ADDED * (model.distinct + 1))
    rest = (
        done.select("row", F.inline("rest"))
        .join(model.rare, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + ADDED) / scale)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    )
    return done.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
