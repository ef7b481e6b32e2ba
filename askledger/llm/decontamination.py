"""Find benchmark passages in documents by q-gram filtering and banded alignment.

Text is compared letter by letter, lower-cased, any white space as one space character; positions stay those of the text.
Benchmark items are cut into windows of `WINDOW` characters, every `STRIDE` characters and at the end, so that a verbatim
run of WINDOW + STRIDE - 1 = 64 characters of an item, the least passage that is always found, holds a whole window. Items
of up to `LONGEST` characters are a window as a whole as well. A window of m characters may differ by e = `RATE` * m edits.
A part of 120 characters with 9 edits has 4 or fewer in one of its halves, so the short windows find it too.

With at most e edits, window and passage share at least m + 1 - q (e + 1) q-grams, and those lie on diagonals (place in
the text less place in the window) at most 2e apart. Shared q-grams are counted in overlapping bands of diagonals; bands
that reach the bound are aligned, both ends free in the text. Nothing else is aligned and nothing that meets the bound is
left out.

Documents are only scanned: no shuffle, no groups. The index of the windows is broadcast; it holds at most about
`INDEX_CHARS` characters of items. Larger benchmarks are cut by a hash of the item into several indexes, each with a scan
of its own.

Defined results: null and empty texts have no matches; items of fewer than 2q characters must occur verbatim, whatever
their length; those of white space only match nothing; repeated items and documents each give their own rows; null ids are carried along; an empty
benchmark or document table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askledger.llm.common import sliced

Q = 10
WINDOW, STRIDE = 60, 5
LONGEST = 120
RATE = 0.08
BAND = 32
INDEX_CHARS = 1 << 20
SCAN_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD1342543DE82EF95)
_FLAGS = 22

_folded: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> the code point it is compared as. Made once in each Python process."""
    global _folded
    if _folded is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isspace():
                table[c] = 32
            elif x.isupper() and len(low := x.lower()) == 1:
                table[c] = ord(low)
        _folded = table
    return _folded


def folded(text: str) -> np.ndarray:
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _plain(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of every run of Q code points, from runs of 2, 4 and 8."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    b = [np.uint64(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4)]
    c = points.astype(np.uint64)
    two = c[:-1] * b[0] + c[1:]
    four = two[:-2] * b[1] + two[2:]
    eight = four[:-4] * b[2] + four[4:]
    n = len(points) - Q + 1
    return (eight[:n] * b[1] + two[8 : 8 + n]) * _MIX


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def budget(length: int) -> int:
    """Edits allowed in a window: RATE of it, as long as the q-gram bound stays positive."""
    return max(0, min(int(RATE * length), (length + 1) // Q - 2)) if length >= 2 * Q else 0


def window_starts(length: int) -> list[int]:
    if length <= WINDOW:
        return [0]
    return sorted({*range(0, length - WINDOW + 1, STRIDE), length - WINDOW, max(0, length - 2 * WINDOW)})


def windows_of(points: np.ndarray) -> list[np.ndarray]:
    whole = [points] if WINDOW < len(points) <= LONGEST else []
    return whole + [points[start : start + WINDOW] for start in window_starts(len(points))]


@dataclass
class Index:
    """Windows, and for each of their q-grams (in order of hash) the windows and places that have it."""

    items: list
    windows: list[np.ndarray]
    owner: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    window: np.ndarray
    place: np.ndarray
    flags: np.ndarray
    #: Item number and folded text of items of fewer than Q characters.
    short: list[tuple[int, str]]

    @classmethod
    def of(cls, items: list[tuple]) -> Index:
        windows, owner, hashes, window, place, short = [], [], [], [], [], []
        for k, (_, text) in enumerate(items):
            points = folded(text or "")
            if len(points) < Q:
                if (points != 32).any():
                    short.append((k, _plain(points)))
                continue
            for part in windows_of(points):
                h = gram_hashes(part)
                hashes.append(h)
                window.append(np.full(len(h), len(windows)))
                place.append(np.arange(len(h)))
                windows.append(part)
                owner.append(k)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        grams, starts = np.unique(every[order], return_index=True)
        flags = np.zeros(1 << _FLAGS, bool)
        flags[grams >> np.uint64(64 - _FLAGS)] = True
        least = np.array([len(w) + 1 - Q * (budget(len(w)) + 1) for w in windows], np.int64)
        joined = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int64))[order].astype(np.int32)
        return cls([i for i, _ in items], windows, np.array(owner, np.int64), least, grams, np.append(starts, len(every)), joined(window), joined(place), flags, short)

    def candidates(self, points: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, window, band) in which as many q-grams of the window are met as the bound asks. `doc` numbers the document of each
        code point; places count from the start of all of them, which only shifts bands."""
        if not len(self.grams):
            return np.zeros((0, 3), np.int64)
        h = gram_hashes(points)
        at = np.flatnonzero(self.flags[h >> np.uint64(64 - _FLAGS)])
        g = np.searchsorted(self.grams, h[at])
        real = self.grams[np.minimum(g, len(self.grams) - 1)] == h[at]
        at, g = at[real], g[real]
        n = self.starts[g + 1] - self.starts[g]
        post = np.repeat(self.starts[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        window, band = self.window[post].astype(np.int64), (at - self.place[post] + LONGEST) // BAND
        # one number for document, window, band and place: batches are bounded in rows and bytes, so it fits 63 bits
        bands = int(band.max(initial=0)) + 2
        key = _distinct(((doc[at] * len(self.windows) + window) * bands + band + 1) * LONGEST + self.place[post])
        # every band also counts with the one before it; a place that several runs of the text match counts once
        group, count = np.unique(_distinct(np.concatenate((key, key - LONGEST))) // LONGEST, return_counts=True)
        group, band = np.divmod(group, bands)
        found, window = np.divmod(group, len(self.windows))
        return np.stack((found, window, band - 1), axis=1)[count >= self.least[window]]


def align(window: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best place for the whole window in the region, if it needs `most` edits or fewer.

    One row of the alignment table per character of the window, all columns of the region's diagonals at once; the
    cost of skipping characters of the text inside a row is a running minimum.
    """
    size = window.itemsize
    verbatim = region.tobytes().find(window.tobytes())
    if verbatim >= 0 and verbatim % size == 0:
        return 0, verbatim // size, verbatim // size + len(window)
    columns = np.arange(len(region) + 1)
    row, began = np.zeros(len(region) + 1, np.int64), columns.copy()
    for k, c in enumerate(window.tolist(), 1):
        new, source = row + 1, began.copy()
        match = row[:-1] + (region != c)
        better = match <= new[1:]
        new[1:][better], source[1:][better] = match[better], began[:-1][better]
        new[0] = k
        lead = new - columns
        low = np.minimum.accumulate(lead)
        take = np.maximum.accumulate(np.where(lead == low, columns, 0))
        row, began = low + columns, source[take]
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(began[end]), end) if row[end] <= most else None


def passages(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of every item found in a text: the hull of its windows there."""
    gap = "\0" * WINDOW  # nothing reaches over it unnoticed: it costs more edits than any budget
    joined = gap.join(t or "" for t in texts)
    lengths = np.array([len(t or "") for t in texts])
    starts = np.cumsum(lengths + WINDOW) - (lengths + WINDOW)
    points = folded(joined)
    doc = np.repeat(np.arange(len(texts)), lengths + WINDOW)[: len(points)]
    found: dict[tuple[int, int], list[int]] = {}
    done = set()
    for d, w, band in index.candidates(points, doc).tolist():
        low = max(int(starts[d]), band * BAND - LONGEST - BAND)
        high = min(int(starts[d] + lengths[d]), (band + 2) * BAND + BAND)
        window = index.windows[w]
        most = budget(len(window))
        hit = align(window, points[low:high], most)
        if hit is None or (w, low + hit[1]) in done:
            continue
        done.add((w, low + hit[1]))
        start, end = low + hit[1] - int(starts[d]), low + hit[2] - int(starts[d])
        span = found.setdefault((d, int(index.owner[w])), [start, end, hit[0]])
        span[:] = min(span[0], start), max(span[1], end), min(span[2], hit[0])
    for d in range(len(texts)) if index.short else ():
        text = _plain(points[starts[d] : starts[d] + lengths[d]])
        for item, wanted in index.short:
            if (start := text.find(wanted)) >= 0:
                found[d, item] = [start, text.rfind(wanted) + len(wanted), 0]
    for (d, item), (start, end, edits) in found.items():
        yield d, item, start, end, edits


def indexes(benchmark: DataFrame, id_column: str, text_column: str, chars: int) -> Iterator[Index]:
    """Indexes that together hold all items; each is bounded."""
    items = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / chars))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        if rows:
            yield Index.of([(r["id"], r["text"]) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", index_chars: int = INDEX_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row for each item found in a document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long"
    out = None
    for index in indexes(benchmark, item_column, item_text, index_chars):
        shared = spark.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, 1, SCAN_BYTES):
                rows = sorted(passages(shared.value, b.column(1).to_pylist()))
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                named = pa.array([shared.value.items[r[1]] for r in rows], pa.int64())
                yield pa.record_batch([ids, named, *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))], ["doc_id", "item_id", "start", "end", "edits"])

        found = texts.mapInArrow(task, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", index_chars: int = INDEX_CHARS) -> DataFrame:
    """The documents without any benchmark passage, all columns kept."""
    at = docs.columns.index(text_column)
    for index in indexes(benchmark, item_column, item_text, index_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches, at, SCAN_BYTES):
                hit = {r[0] for r in passages(shared.value, b.column(at).to_pylist())}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
