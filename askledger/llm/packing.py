"""Pack token streams into fixed windows, in document order, by dynamic programming over allowed cuts.

The documents of an input partition form one stream of ids in their order there. A cut after position j costs 0 at a
document's end, `sentence_cost` at a sentence's end and `inside_cost` elsewhere, in tokens of padding. With best(j) the
least cost of the stream up to cut j,

    best(j) = cost(j) + window - pos(j) + min { best(i) + pos(i) : 0 < pos(j) - pos(i) <= window }

The minimum runs over a sliding range of cuts, so a queue whose values only rise gives it in constant time. Besides the
ends of documents and sentences, cuts inside a sentence are offered every `inside_step` tokens. The stream is cut in blocks of
`block` tokens; each hands its last, unfinished window to the next, so memory stays bounded and partitions need no
shuffle. The last window of a partition may be split at powers of two, which need no padding, if that costs less.

Defined results: a null text counts as empty and packs as the closing id alone; a null or repeated id is carried along
and each row is packed for itself; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askledger.llm import bpe

WINDOW = 2048
CLOSING_ID = 1
#: Cost of a cut, as tokens of padding: after a sentence, and anywhere else.
SENTENCE_COST = 1.0
INSIDE_COST = 12.0
INSIDE_STEP = 64
BLOCK = 1 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def allowed_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, sentence_cost: float, inside_cost: float, inside_step: int):
    """Positions where a window may end, in order, and what each costs."""
    inside = np.arange(inside_step, doc_ends[-1], inside_step)
    pos = np.concatenate((doc_ends, sentence_ends, inside))
    cost = np.repeat([0.0, sentence_cost, inside_cost], [len(doc_ends), len(sentence_ends), len(inside)])
    pos, first = np.unique(pos, return_index=True)  # the first of equal ones is the cheapest
    return pos, cost[first]


def best_cuts(pos: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """Ends of the windows of least total cost; `pos` rises, its last entry is the stream's end, no gap is over a window."""
    positions, costs = [0, *pos.tolist()], [0.0, *cost.tolist()]
    came = [0] * len(positions)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # value best + pos, position, index
    for j in range(1, len(positions)):
        p = positions[j]
        oldest = p - window
        while queue[0][1] < oldest:
            queue.popleft()
        value, _, came[j] = queue[0]
        value += costs[j] + window  # best(j) + pos(j): the position cancels out
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
    ends, j = [], len(positions) - 1
    while j:
        ends.append(positions[j])
        j = came[j]
    return ends[::-1]


def tail_cuts(start: int, end: int, window: int, inside_cost: float) -> list[int]:
    """Ends of the windows for a last stretch: padded whole, or split at powers of two if that costs less."""
    length = end - start
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    if len(parts) == 1 or (len(parts) - 1) * inside_cost >= window - length:
        return [end]
    return (start + np.cumsum(parts)).tolist()


class Stream:
    """The ids not yet cut off, with the documents they belong to."""

    def __init__(self, first_sequence: int, window: int, costs: tuple[float, float, int]):
        self.window, self.costs = window, costs
        self.sequence = first_sequence
        self.docs: list[tuple] = []  # id, ids of the document, how many of them are already cut off
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)

    def cut(self, ends_sentence: np.ndarray, last: bool) -> list[tuple]:
        """Pieces of all finished windows; what is left starts the next block."""
        if not self.size:
            return []
        ids = np.concatenate([d[1][d[2] :] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        pos, cost = allowed_cuts(doc_ends, np.flatnonzero(ends_sentence[ids]) + 1, *self.costs)
        ends = best_cuts(pos, cost, self.window)
        if last:
            begun = ends[-2] if len(ends) > 1 else 0
            ends[-1:] = tail_cuts(begun, ends[-1], self.window, self.costs[1])
        elif len(ends) > 1:
            ends.pop()
        else:
            return []
        return self._pieces(ids, doc_ends.tolist(), ends)

    def _pieces(self, ids: np.ndarray, doc_ends: list[int], ends: list[int]) -> list[tuple]:
        pieces, begun, d = [], 0, 0
        data = ids.astype("<u4")
        for end in ends:
            at = begun
            while at < end:
                doc_id, whole, done = self.docs[d]
                to = min(end, doc_ends[d])
                start = len(whole) - (doc_ends[d] - at)
                pieces.append((doc_id, start, to - at, zlib.crc32(data[at:to]), len(whole), self.sequence, at - begun))
                at = to
                if to == doc_ends[d]:
                    d += 1
            self.sequence += 1
            begun = end
        left = len(ids) - begun
        self.docs = self.docs[d:]
        if self.docs:
            doc_id, whole, _ = self.docs[0]
            self.docs[0] = (doc_id, whole, len(whole) - (doc_ends[d] - begun))
        self.size = left
        return pieces


def pack_texts(rows: Iterator[tuple], encoder: bpe.Encoder, first_sequence: int, window: int, costs: tuple[float, float, int], block: int) -> Iterator[list[tuple]]:
    """Lists of pieces of (id, text) rows, in their order."""
    ends_sentence = encoder.flags(lambda b: b.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in b)
    stream = Stream(first_sequence, window, costs)
    for doc_id, text in rows:
        stream.add(doc_id, np.array([*encoder.ids_with_added(text or ""), CLOSING_ID], np.int32))
        if stream.size >= block:
            yield stream.cut(ends_sentence, last=False)
    yield stream.cut(ends_sentence, last=True)


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, window: int = WINDOW, sentence_cost: float = SENTENCE_COST, inside_cost: float = INSIDE_COST, inside_step: int = INSIDE_STEP, block: int = BLOCK) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence. Sequence ids are unique, not dense."""

    costs = (sentence_cost, inside_cost, min(inside_step, window))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        rows = ((i, t.as_py()) for i, t in rows)
        for pieces in pack_texts(rows, bpe.Encoder(vocabulary), first, window, costs, block):
            if pieces:
                columns = list(zip(*pieces, strict=True))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=ARROW)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(task, SCHEMA)
