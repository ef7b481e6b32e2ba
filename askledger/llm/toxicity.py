"""Toxicity by a convolutional text classifier, trained in numpy.

A word has two hashed embeddings, of the word and of its first letters, one after the other. Filters over one, two and
three words give numbers for every place; the largest over the whole text, rectified, is a feature; a logistic unit
weighs the features. Embeddings start from the hashed log-odds of the training labels, all other weights from a fixed
seed; training runs over documents in a fixed order with Adagrad steps. A row of the tables that fewer than
`LEAST_DOCUMENTS` training documents use stays zero, so unseen words say nothing.

Thresholds are calibrated by language: a fifth of the training rows is kept back, and for each language, as identified
from the text by the rank-order profiles, the threshold of best F1 is found there (the overall one for languages with
fewer than `LEAST_POSITIVE` toxic rows). The score is the logistic of the distance to the threshold: 0.5 stands on it.

Training takes every labelled row that may be learned from: four fifths set the weights, the rest the thresholds, told
apart by a hash of the id. Document counts are summed by Spark. In each epoch every task trains on its rows, about
`TASK_ROWS`, from the weights of the epoch before; what the tasks changed is averaged, weight by weight. The driver holds
the weights, whose number is fixed, never the rows. Thresholds come from counts of logits in steps of 1 / `GRID`. Every
document is scored over its whole text, and text is all a score sees.

Defined results: null or empty texts, and all texts if nothing was learned from, get a score too, from no words; labels
of null or unknown ids are not used, of several labels of an id the largest counts; null or repeated ids are carried
along; other columns are ignored.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.llm import language
from askledger.llm.common import sliced, stored

START_BITS = 16
WORD_ROWS, START_ROWS = 1 << 19, 1 << START_BITS
START_LETTERS = 4
WIDTH = 8
SPANS = (1, 2, 3)
FILTERS = 8
EPOCHS = 4
STEP = 0.1
#: Rows one task trains on, about; steps of the logits for thresholds, per unit, and the largest logit counted apart.
TASK_ROWS = 8000
GRID, LARGEST = 1024, 100
#: Bytes that hold a word's rows.
ROW_BYTES = 5
LEAST_POSITIVE = 12
#: Documents that must use a row for it to be learned, and the weight of the overall share in its first log-odds.
LEAST_DOCUMENTS, PRIOR = 3, 8.0
SLICE_BYTES = 1 << 18
CACHE_WORDS = 200_000

#: Every filter's place in a text, once for each word of its window: the filter, the word's place in the window, and both
#: of them as one stage, in which a row of the tables takes one step.
_FILTER = np.array([j * FILTERS + f for j, span in enumerate(SPANS) for _ in range(span) for f in range(FILTERS)])
_OFFSET = np.array([k for span in SPANS for k in range(span) for _ in range(FILTERS)])
_STAGES = sum(SPANS)
_STAGE = np.repeat(np.arange(_STAGES), FILTERS)

_WORD = re.compile(r"[^\W\d_]+")
#: For texts of one byte a code point: what is no letter becomes a space.
_LETTERS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


class WordRows(dict):
    """word -> row in the word table, and row in the table of first letters, as one number."""

    def __missing__(self, word: str | bytes) -> int:
        if isinstance(word, bytes) and word.isascii():
            whole, first = word, word[:START_LETTERS]
        else:
            letters = word.decode("latin-1") if isinstance(word, bytes) else word
            whole, first = letters.encode(), letters[:START_LETTERS].encode()
        own = xxhash.xxh3_64_intdigest(whole) % (WORD_ROWS - 1) + 1
        start = xxhash.xxh3_64_intdigest(first, 1) % (START_ROWS - 1) + 1
        value = self[word] = own * START_ROWS + start
        return value

    def of(self, text: str | None) -> list[int]:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = (text or "").lower()
        try:
            words = text.encode("latin-1").translate(_LETTERS).split()
        except UnicodeEncodeError:
            words = _WORD.findall(text)
        return list(map(self.__getitem__, words))


@dataclass
class Network:
    """`table` has the rows of words, then those of first letters; row 0 of each is the gap between texts and stays zero.

    `filters` has for each width and word of its window (a stage) what the filters of that width make of that word.
    """

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    level: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0

    @staticmethod
    def slots(rows: np.ndarray) -> np.ndarray:
        """Both rows of the table of each word."""
        at = np.empty((len(rows), 2), np.int64)
        np.right_shift(rows, START_BITS, out=at[:, 0])
        np.bitwise_and(rows, START_ROWS - 1, out=at[:, 1])
        at[:, 1] += WORD_ROWS
        return at

    def responses(self, slots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The inputs; per filter width, what each filter gives at each place of them (a window begins there)."""
        x = self.table.take(slots, axis=0).reshape(len(slots), 2 * WIDTH)
        found, stage = [], 0
        for span in SPANS:
            r = x[: len(x) - span + 1] @ self.filters[stage]
            for k in range(1, span):
                r += x[k : len(x) - span + 1 + k] @ self.filters[stage + k]
            found.append(r)
            stage += span
        return x, found

    def logits(self, texts: list[list[int]]) -> np.ndarray:
        """One number per text; texts are laid one after the other with gaps wider than any filter."""
        gap = max(SPANS)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + gap) - (lengths + gap)
        rows = np.zeros(int((lengths + gap).sum()) + gap, np.int64)
        for s, t in zip(starts.tolist(), texts, strict=True):
            rows[s : s + len(t)] = t
        # only windows that begin in a text count, for an empty one the first of its gap
        bounds = np.stack((starts, starts + np.maximum(lengths, 1)), axis=1).reshape(-1)
        pooled = np.concatenate([np.maximum.reduceat(r, bounds)[::2] for r in self.responses(self.slots(rows))[1]], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.level

    def score(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        at = np.array([self.thresholds.get(x, self.threshold) for x in languages])
        return 1 / (1 + np.exp(-np.clip(logits - at, -40, 40)))


def untrained(share: float = 0.5) -> Network:
    rng = np.random.default_rng(11)
    filters = np.concatenate([rng.normal(0, 0.15, (span, 2 * WIDTH, FILTERS)).astype(np.float32) for span in SPANS])
    filters[:, 0, : FILTERS // 2] += 0.5  # towards the log-odds of words and of first letters
    filters[:, WIDTH, : FILTERS // 2] += 0.35
    level = float(np.log(share / (1 - share)))
    n = FILTERS * len(SPANS)
    return Network(np.zeros((WORD_ROWS + START_ROWS, WIDTH), np.float32), filters, np.full(n, -0.5, np.float32), np.full(n, 0.1, np.float32), level)


def _packed(rows: list[int]) -> bytes:
    return np.array(rows, "<i8").view(np.uint8).reshape(-1, 8)[:, :ROW_BYTES].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // ROW_BYTES, 8), np.uint8)
    wide[:, :ROW_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, ROW_BYTES)
    return wide.view("<i8").reshape(-1).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows: per row of the two tables, one after the other, the toxic and the clean documents that use it."""
    found = np.zeros((2, WORD_ROWS + START_ROWS), np.int64)
    for b in batches:
        for blob, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = _unpacked(blob)
            found[1 - y, np.unique(rows // START_ROWS)] += 1
            found[1 - y, WORD_ROWS + np.unique(rows % START_ROWS)] += 1
    at = np.flatnonzero(found.any(0))
    yield pa.record_batch([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], ["slot", "toxic", "clean"])


def started(slots: np.ndarray, toxic: np.ndarray, clean: np.ndarray, share: float) -> tuple[Network, np.ndarray]:
    """The network before training, and which rows of its table are learned: those that enough documents use."""
    rng = np.random.default_rng(12)
    net = untrained(share)
    counts = np.zeros((2, WORD_ROWS + START_ROWS))
    counts[0, slots], counts[1, slots] = toxic, clean
    odds = np.log((counts[0] + PRIOR * share) / (counts[1] + PRIOR * (1 - share)) * (1 - share) / share)
    known = counts.sum(0) >= LEAST_DOCUMENTS
    known[[0, WORD_ROWS]] = False
    net.table[known] = rng.normal(0, 0.02, (int(known.sum()), WIDTH))
    net.table[known, 0] = np.clip(odds[known], -3, 3)
    return net, known


def _weights(net: Network) -> list[np.ndarray]:
    return [net.table, net.filters, net.bias, net.out]


def fit(net: Network, known: np.ndarray, squares: list[np.ndarray], share: float, texts: list[np.ndarray], labels: np.ndarray, seed: int) -> None:
    """One pass of Adagrad steps over texts given as word rows; changes `net` and `squares`."""
    weight = np.where(labels > 0, (1 - share) / share, 1.0) ** 0.5
    gap, every = np.zeros(max(SPANS), np.int64), np.arange(FILTERS)

    def step(x: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        s += g * g
        x -= STEP * g / np.sqrt(s)

    def table_step(own: np.ndarray, back: np.ndarray, stage: np.ndarray) -> None:
        """A step for each stage that uses a row of the table, one after the other; those of all rows at once."""
        order = own.argsort()
        ordered = own[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        rows, place = ordered[first], np.empty(len(own), np.int64)
        place[order] = first.cumsum() - 1
        g = np.zeros((_STAGES + 1, len(rows), WIDTH), np.float32)
        np.add.at(g[1:].reshape(-1, WIDTH), stage * len(rows) + place, back)
        s = g * g
        s[0] = squares[0].take(rows, axis=0)
        np.add.accumulate(s, axis=0, out=s)
        g[1:] *= STEP
        g[1:] /= np.sqrt(s[1:])
        g[0] = net.table.take(rows, axis=0)
        net.table[rows], squares[0][rows] = np.subtract.reduce(g, axis=0), s[-1]

    for d in np.random.default_rng(seed).permutation(len(texts)):
        slots = net.slots(np.concatenate((texts[d], gap)))
        x, responses = net.responses(slots)
        places, most = [], []
        for r in responses:
            at = r[: max(1, len(texts[d]))].argmax(0)
            places.append(at)
            most.append(r[at, every])
        pooled = np.concatenate(most) + net.bias
        feature = np.maximum(pooled, 0)
        error = weight[d] * (1 / (1 + np.exp(-np.clip(feature @ net.out + net.level, -40, 40))) - labels[d])
        into = error * net.out * (pooled > 0)
        step(net.out, squares[-1], error * feature + 1e-4 * net.out)
        step(net.bias, squares[-2], into)
        net.level -= 0.02 * error
        g = into[_FILTER]
        used = g.nonzero()[0]
        if not len(used):
            continue
        at, g = np.concatenate(places)[_FILTER[used]] + _OFFSET[used], g[used, None]
        back = (g * net.filters.transpose(0, 2, 1).reshape(-1, 2 * WIDTH)[used]).reshape(-1, 2, WIDTH)
        change = np.zeros((len(_FILTER), 2 * WIDTH))
        change[used] = x[at] * g
        step(net.filters, squares[1], change.reshape(_STAGES, FILTERS, 2 * WIDTH).transpose(0, 2, 1))
        own = slots[at]
        word, table = known[own].nonzero()
        if len(word):
            table_step(own[word, table], back[word, table], _STAGE[used[word]])


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The threshold of best F1: halfway between two neighbouring values, the lower of equals.

    With `counts`, a logit stands for so many rows and its label for how many of them are toxic.
    """
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(np.ones(len(order)) if counts is None else counts[order]) + labels.sum())
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


_PAIR = ", ".join(f"{c}{k} float" for c in "xs" for k in range(WIDTH))


def _flat(parts: list[np.ndarray], level: float) -> np.ndarray:
    """All weights as rows of WIDTH numbers; the level has the last row for itself."""
    return np.concatenate([p.reshape(-1, WIDTH) for p in parts] + [np.full((1, WIDTH), level, np.float32)]).astype(np.float32)


def _epoch(front: DataFrame, net: Network, known: np.ndarray, squares: list[np.ndarray], share: float, seed: int) -> None:
    """Every task trains on its rows; the weights that tasks changed become the average of what those tasks made of them."""
    shared = front.sparkSession.sparkContext.broadcast((net, known, squares, share))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, learned, before, part = shared.value
        own = copy.deepcopy(base)
        sums = [s.copy() for s in before]
        for b in batches:
            fit(own, learned, sums, part, [_unpacked(x) for x in b.column(0).to_pylist()], np.array(b.column(1).to_pylist(), np.float64), seed)
        new, old = _flat(_weights(own), own.level), _flat(_weights(base), base.level)
        grown, was = _flat(sums, 0.0), _flat(before, 0.0)
        at = np.flatnonzero((new != old).any(1) | (grown != was).any(1))
        yield pa.record_batch([pa.array(at.astype(np.int32)), *[pa.array(v[at, k]) for v in (new, grown) for k in range(WIDTH)]], ["slot", *[f"{c}{k}" for c in "xs" for k in range(WIDTH)]])

    names = [f"{c}{k}" for c in "xs" for k in range(WIDTH)]
    changed = front.select("words", "y").mapInArrow(task, f"slot int, {_PAIR}").groupBy("slot").agg(*[F.avg(c).cast("float").alias(c) for c in names])
    # As many rows as the network has, however many documents there are.
    table = changed.toArrow()
    shared.destroy()
    at = table.column("slot").to_numpy()
    values = np.stack([table.column(c).to_numpy() for c in names], axis=1) if len(at) else np.zeros((0, 2 * WIDTH), np.float32)
    for flat, parts, cols in ((_flat(_weights(net), net.level), _weights(net), slice(0, WIDTH)), (_flat(squares, 0.0), squares, slice(WIDTH, 2 * WIDTH))):
        flat[at] = values[:, cols]
        start = 0
        for p in parts:
            p[...] = flat[start : start + p.size // WIDTH].reshape(p.shape)
            start += p.size // WIDTH
        if parts is not squares:
            net.level = float(flat[-1, 0])


def _calibrate(back: DataFrame, net: Network, profiles: language.Profiles) -> None:
    """Thresholds from the counts of rows and of toxic rows in each step of the logits, by language."""
    shared = back.sparkSession.sparkContext.broadcast((net, profiles))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spoken = shared.value
        rows = WordRows()
        for b in sliced(batches, 0, SLICE_BYTES):
            texts = b.column(0).to_pylist()
            steps = np.round(np.clip(model.logits([rows.of(t) for t in texts]), -LARGEST, LARGEST) * GRID).astype(np.int32)
            yield pa.record_batch([pa.array([spoken.nearest(t)[0] for t in texts], pa.string()), pa.array(steps), b.column(1)], ["language", "step", "y"])

    counts = back.select("text", "y").mapInArrow(task, "language string, step int, y int").groupBy("language", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic"))
    # A row for each language and step at most.
    found = counts.orderBy("language", "step").toArrow()
    spoken, at, n, toxic = np.array(found.column("language").to_pylist(), object), found.column("step").to_numpy() / GRID, found.column("n").to_numpy(), found.column("toxic").to_numpy()
    if not toxic.sum():
        return
    steps, place = np.unique(at, return_inverse=True)
    net.threshold = best_threshold(steps, np.bincount(place, toxic), np.bincount(place, n))
    for name in set(spoken.tolist()):
        own = spoken == name
        if toxic[own].sum() >= LEAST_POSITIVE:
            net.thresholds[name] = best_threshold(at[own], toxic[own], n[own])


def train(docs: DataFrame, labels: DataFrame, usable: Column, profiles: language.Profiles, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", task_rows: int = TASK_ROWS) -> Network:
    marked = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).cast("int").alias("y"))
    known = docs.where(usable & F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("place")).join(marked.hint("shuffle_hash"), "id")
    # Labels grow with the documents, so they are never broadcast, and long texts are not sorted to meet them.
    kept_back = F.pmod(F.xxhash64("id"), F.lit(5)) == 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows()
        for b in sliced(batches, 0, SLICE_BYTES):
            yield pa.record_batch([pa.array([_packed(rows.of(t)) for t in b.column(0).to_pylist()], pa.binary()), b.column(1), b.column(2)], ["words", "y", "place"])

    tasks = max(1, -(-marked.count() // task_rows))
    packed = known.where(~kept_back).select("text", "y", "place").mapInArrow(task, "words binary, y int, place long")
    # A task's rows are trained on in the order of the input, not in that of the shuffle.
    front = stored(packed.coalesce(tasks).sortWithinPartitions("place").select("words", "y"), "training")
    n, toxic = front.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or toxic in (0, n):
        net = untrained(np.clip(toxic / n, 0.01, 0.99) if n else 0.5)
    else:
        share = toxic / n
        # A row for each row of the two tables at most.
        used = front.mapInArrow(_counted, "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
        net, learned = started(*(used.column(c).to_numpy() for c in ("slot", "toxic", "clean")), share)
        squares = [np.full_like(x, 1e-2) for x in _weights(net)]
        for epoch in range(EPOCHS):
            _epoch(front, net, learned, squares, share, 12 + epoch)
    _calibrate(known.where(kept_back), net, profiles)
    return net


def score(docs: DataFrame, net: Network, profiles: language.Profiles, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((net, profiles))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        rows = WordRows()
        for b in sliced(batches, 1, SLICE_BYTES):
            texts = b.column(1).to_pylist()
            s = model.score(model.logits([rows.of(t) for t in texts]), [known.nearest(t)[0] for t in texts])
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(task, "doc_id long, score double, predicted int")
