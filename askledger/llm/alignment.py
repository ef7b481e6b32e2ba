"""Align two tokenizers' ids of the same text by the places where tokens of both end.

A is a byte-level BPE of a space plus the text, B a sentence-piece model of the text, which adds that space itself. Each
token's bytes give the end of its byte range; a dictionary from end to token index is made for either tokenizer, the ends
that both have, in order, slice both lists of ids into groups, and each slice gives its link, the pair of tokens that end
together where it ends.

No token of either reaches over a space that follows a character other than white space, so a text is cut there into parts
that are aligned for themselves: the same ids, groups and links, but a part that was met before is looked up. Should B's
vocabulary hold a piece with a space inside, texts are one part.

How often a pair of ids is linked in the corpus is counted from the distinct pairs of each document, which are stored. The
commonest pairs, at most `BROADCAST_PAIRS`, are broadcast to score the documents; all others are joined by pair. None of
those is common, so no key of that join is hot. The highest count of each B id has one row per id of the vocabulary.

Defined results: null and empty texts, and those whose tokens' bytes are not the text's, have no tokens: zeros and an empty
hash; strings of special tokens inside texts are plain text; null and repeated ids are carried along, each row for itself;
an empty table gives no rows; other columns are ignored. Memory is bounded by the longest text and its ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, compress
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askledger.llm import bpe
from askledger.llm.common import prepare, sliced, stored

BROADCAST_PAIRS = 1 << 18
#: Bytes of parts remembered by a Python process, parts learned at a time, bytes of texts taken at a time.
CACHED_BYTES = 4 << 20
LEARNED = 20_000
SLICE_BYTES = 4 << 20
#: Width of the steps in which pairs are told apart by their counts: an eighth of a power of two.
STEPS = 8

SPACE = "▁"

def default_pieces() -> str:
    """Path on this machine of the sentence-piece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def slices(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The ends that both have, in order, and how many tokens of A and of B lie before each. Every token has bytes."""
    a_at, b_at = ({end: k for k, end in enumerate(ends, 1)} for ends in (a_ends, b_ends))
    common = sorted(a_at.keys() & b_at.keys())
    return common, *(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (a_at, b_at))


def written(a: np.ndarray, b: np.ndarray, a_before: np.ndarray, b_before: np.ndarray, a_names: np.ndarray, b_names: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3;` token by token. The names of ids are each followed by a comma, then by what ends a slice."""
    out = np.empty(len(a) + len(b), object)
    of = lambda before: np.repeat(np.arange(len(before)), np.diff(before, prepend=0))
    for ids, place, before, names in (
        (a, np.arange(len(a)) + np.concatenate(([0], b_before))[of(a_before)], a_before, a_names),
        (b, np.arange(len(b)) + a_before[of(b_before)], b_before, b_names),
    ):
        last = np.zeros(len(ids), np.int64)
        last[before - 1] = len(names) // 2
        out[place] = names[ids + last]
    return out.tolist()


class Aligner(dict):
    """part of a text -> (groups as text, links as packed pair numbers, tokens of A, tokens of B, groups), or None if bytes
    differ. Parts are learned many at a time: a part ends for both tokenizers, so parts one after the other are one text."""

    def __init__(self, vocabulary: str | None = None, pieces: str | None = None):
        import sentencepiece

        super().__init__()
        self.a = bpe.Encoder(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or default_pieces())
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(names)]
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        self.a_lengths = np.array([len(self.a.pieces.get(k, b"")) for k in range(max(self.a.pieces) + 1)])
        self.a_names, self.b_names = (np.array([f"{k}{mark}" for mark in marks for k in range(n)], object) for n, marks in ((len(self.a_lengths), ",|"), (len(names), ",;")))
        inner = any(SPACE in p.lstrip(SPACE) for p in names)
        self.cut = None if inner else re.compile(r"(?<=\S) (?!\Z)")
        self.held = 0

    def parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def learn(self, parts: list[str]) -> None:
        wanted, found = [(" " + p).encode() for p in parts], self.b.encode(parts, num_threads=1)
        self.held += sum(map(len, wanted))
        named = lambda ids: b"".join(map(self.b_bytes.__getitem__, ids))
        if named(chain.from_iterable(found)) != b"".join(wanted):
            good = [named(ids) == w for ids, w in zip(found, wanted, strict=True)]
            self.update((p, None) for p, g in zip(parts, good, strict=True) if not g)
            parts, wanted, found = (list(compress(x, good)) for x in (parts, wanted, found))
        if not parts:
            return
        a, b = np.array(self.a.ids(b"".join(wanted).decode()), np.int64), np.fromiter(chain.from_iterable(found), np.int64)
        common, a_before, b_before = slices(np.cumsum(self.a_lengths[a]).tolist(), np.cumsum(self.b_lengths[b]).tolist())
        names = written(a, b, a_before, b_before, self.a_names, self.b_names)
        pairs = (a[a_before - 1] * len(self.b_bytes) + b[b_before - 1]).tobytes()
        last = np.searchsorted(common, np.cumsum([len(w) for w in wanted]), "right")  # groups up to the end of each part
        i = j = g = 0
        for part, i2, j2, g2 in zip(parts, a_before[last - 1].tolist(), b_before[last - 1].tolist(), last.tolist(), strict=True):
            self[part] = "".join(names[i + j : i2 + j2]), pairs[8 * g : 8 * g2], i2 - i, j2 - j, g2 - g
            i, j, g = i2, j2, g2

    def texts(self, texts: list[str | None]) -> Iterator[list | None]:
        """For each text what its parts give, in order; None if it has no tokens."""
        if self.held > CACHED_BYTES:
            self.clear()
            self.held = 0
        split = [self.parts(t) if t else [] for t in texts]
        fresh = list({p for parts in split for p in parts} - self.keys())
        for k in range(0, len(fresh), LEARNED):
            self.learn(fresh[k : k + LEARNED])
        for parts in split:
            found = [self[p] for p in parts]
            yield None if not found or None in found else found


_aligners: dict[tuple, Aligner] = {}


def aligner(vocabulary: str | None, pieces: str | None) -> Aligner:
    """One for each Python process and pair of vocabularies."""
    if (vocabulary, pieces) not in _aligners:
        _aligners[vocabulary, pieces] = Aligner(vocabulary, pieces)
    return _aligners[vocabulary, pieces]


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, pieces: str | None = None, whole: bool = True) -> DataFrame:
    """row (unique, only for one run), doc_id, n_a, n_b, n_groups, n_links, pairs (distinct, A's id times the size of B's
    vocabulary plus B's id), times, and groups (as text `a1,a2|b1;a3|b2,b3`), or just its hash if not `whole`."""
    name = "groups" if whole else "groups_sha256"
    kinds = [("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), (name, pa.string())]
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<int>, {name} string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = aligner(vocabulary, pieces), TaskContext.get().partitionId() << 33
        for b in sliced(batches, 1, SLICE_BYTES):
            counts, pairs, times, texts = [], [], [], []
            for found in of.texts(b.column(1).to_pylist()):
                if found is None:
                    counts.append((0, 0, 0, 0))
                    texts.append("")
                    pairs.append(np.zeros(0, np.int64))
                    times.append(np.zeros(0, np.int32))
                    continue
                links = np.frombuffer(b"".join(map(itemgetter(1), found)), np.int64)
                counts.append((*(sum(map(itemgetter(k), found)) for k in (2, 3, 4)), len(links)))
                groups = "".join(map(itemgetter(0), found))[:-1]
                texts.append(groups if whole else hashlib.sha256(groups.encode()).hexdigest())
                values, n = np.unique(links, return_counts=True)
                pairs.append(values)
                times.append(n.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            numbers = pa.array(np.arange(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.record_batch([numbers, b.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), *lists, pa.array(texts, pa.string())], schema=pa.schema(kinds))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(task, schema)


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """pair, links (how many hold it in the corpus), best (whether that is the highest of its B id)."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links"))
    each = stored(each, "pairs")
    highest = each.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("links").alias("most"))
    return each.join(F.broadcast(highest), F.col("pair") % b_size == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def common_and_rare(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the highest counts, at most `most` of them, and all others."""
    step = F.floor(F.log2("links") * STEPS).cast("int")
    sizes = pairs.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = 1 << 30, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return pairs.where(step >= least), pairs.where(step < least)


def scored(found: DataFrame, pairs: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """`found` without its lists, with n_best and count_sum over its links."""
    common, rare = common_and_rare(pairs, most)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), "l.times")
    near = links.join(F.broadcast(common), "pair")
    far = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair")
    sums = near.unionByName(far).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")
    )
    kept = found.drop("pairs", "times").join(sums, "row", "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}).drop("row")


def alignment(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, pieces: str | None = None, whole: bool = False, most: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups or groups_sha256 for every row."""
    prepare(docs.sparkSession)
    found = stored(align(docs, id_column, text_column, vocabulary, pieces, whole), "aligned")
    pairs = stored(pair_counts(found, len(aligner(vocabulary, pieces).b_bytes)), "pair-counts")
    return scored(found, pairs, most)
