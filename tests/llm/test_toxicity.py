import copy
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askledger.llm import language, toxicity

BAD = ["idiot", "moron", "scum"]


@pytest.fixture
def trained(spark, documents, prose):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        words = prose(rng.randint(20, 80), k).split()
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic), int(toxic)))
    docs = documents(rows)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    profiles = language.learn(docs, F.col("doc_id") % 5 != 0)
    return docs, dict((k, y) for k, _, y in labels), profiles, toxicity.train(docs, marks, F.col("doc_id") % 5 != 0, profiles)


def test_held_out_rows_are_told_apart(trained):
    docs, labels, profiles, net = trained
    found = {r.doc_id: r for r in toxicity.score(docs, net, profiles).collect()}
    assert len(found) == 240 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    out = [k for k in found if k % 5 == 0]
    assert np.mean([found[k].predicted == labels[k] for k in out]) > 0.93


def test_odd_rows_get_scores(trained, documents, odd_rows):
    _, _, profiles, net = trained
    found = toxicity.score(documents(odd_rows), net, profiles).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(documents([]), net, profiles).collect() == []


def test_slices_do_not_change_scores(trained, prose):
    net = trained[3]
    rows = toxicity.WordRows()
    texts = [rows.of(t) for t in ("", "idiot", prose(50, 1), None, prose(5, 2) + " moron scum")]
    together = net.logits(texts)
    assert np.allclose(together, np.concatenate([net.logits([t]) for t in texts]), atol=1e-4)


def test_nothing_to_learn_from(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    profiles = language.learn(docs, F.lit(True))
    found = toxicity.score(docs, toxicity.train(docs, none, F.lit(True), profiles), profiles).collect()
    assert len(found) == 2 and all(0 <= r.score <= 1 for r in found)


def test_best_threshold_is_best():
    logits, y = np.array([3.0, 2.0, 1.0, 0.5, -1.0]), np.array([1, 1, 0, 1, 0])
    f1 = lambda t: 2 * ((logits >= t) & (y > 0)).sum() / ((logits >= t).sum() + y.sum())
    assert f1(toxicity.best_threshold(logits, y)) == max(f1(t) for t in logits)


def test_every_labelled_row_is_learned_from(spark, documents, prose, monkeypatch):
    """A word of three rows among many is learned: no row is left out, whatever the number of tasks."""
    rows = [(k, prose(6, k) + (" zzyzx" if k in (3, 703, 1101) else " scum" if k % 10 == 1 else ""), "en") for k in range(1200)]
    docs = documents(rows)
    marks = spark.createDataFrame([(k, 0, int("zzyzx" in t or "scum" in t)) for k, t, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.started
    monkeypatch.setattr(toxicity, "started", lambda slots, toxic, clean, share: seen.append((slots, toxic + clean)) or real(slots, toxic, clean, share))
    profiles = language.learn(docs, F.lit(True))
    net = toxicity.train(docs, marks, F.lit(True), profiles, task_rows=100)
    front = {r.id for r in spark.range(1200).where("pmod(xxhash64(id), 5) != 0").collect()}
    at = toxicity.WordRows()["scum"] // toxicity.START_ROWS
    slots, n = seen[0]
    assert n[slots == at].sum() == sum(k in front and "scum" in t for k, t, _ in rows)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, net, profiles).collect()}
    assert np.mean([found[k] == int("zzyzx" in t or "scum" in t) for k, t, _ in rows]) > 0.95


def test_words_of_one_byte_letters_and_others():
    """Texts of one byte a code point are cut without the expression, to the same words."""
    every = "".join(map(chr, range(1, 0x250)))
    for text in ("", None, "É²ß ªº À_1 x", every, every[:255], "日本 a", " a--b\x85c\xa0d "):
        rows = toxicity.WordRows()
        assert rows.of(text) == [toxicity.WordRows()[w] for w in toxicity._WORD.findall((text or "").lower())]


def test_labels_are_not_broadcast(spark, documents, monkeypatch):
    """The join is the same whatever the number of labels: no broadcast that grows with them."""
    plans = []
    real = toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    docs = documents([(k, "a b c") for k in range(20)])
    marks = spark.createDataFrame([(k, 0, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, marks, F.lit(True), language.learn(docs, F.lit(True)))
    assert "ShuffledHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def _plain_fit(net, known, squares, share, text, label):
    """The same steps on one text, row after row."""
    weight = ((1 - share) / share if label else 1.0) ** 0.5
    slots = net.slots(np.concatenate((text, np.zeros(max(toxicity.SPANS), np.int64))))
    x = net.table[slots].reshape(len(slots), -1)
    stages = [net.filters[sum(toxicity.SPANS[:j]) :][:span].copy() for j, span in enumerate(toxicity.SPANS)]
    given = [sum(x[k : len(x) - span + 1 + k] @ w[k] for k in range(span)) for span, w in zip(toxicity.SPANS, stages, strict=True)]
    places = [r[: len(text)].argmax(0) for r in given]
    pooled = np.concatenate([r.max(0, where=(np.arange(len(r)) < len(text))[:, None], initial=-np.inf) for r in given]) + net.bias
    into = weight * (1 / (1 + np.exp(-(np.maximum(pooled, 0) @ net.out + net.level))) - label) * net.out * (pooled > 0)
    for j, (span, w) in enumerate(zip(toxicity.SPANS, stages, strict=True)):
        g = into[j * toxicity.FILTERS :][: toxicity.FILTERS]
        for k in range(span):
            sums = {}
            for f in range(toxicity.FILTERS):
                for half, row in enumerate(slots[places[j][f] + k]):
                    if known[row]:
                        sums[row] = sums.get(row, 0) + g[f] * w[k][half * toxicity.WIDTH :][: toxicity.WIDTH, f]
            for row, total in sums.items():
                squares[row] += total * total
                net.table[row] -= toxicity.STEP * total / np.sqrt(squares[row])


def test_a_text_takes_all_its_steps_at_once(monkeypatch):
    """Rows met in several windows take a step for each, as if one after the other, but are added up once for a text."""
    rng = np.random.default_rng(5)
    net = toxicity.untrained(0.3)
    net.table[:] = rng.normal(0, 0.5, net.table.shape)
    net.bias += 0.5
    known = rng.random(len(net.table)) < 0.8
    words = toxicity.WordRows()
    calls = []

    class Add:
        def __call__(self, *a, **k):
            return add(*a, **k)

        def __getattr__(self, name):
            calls.extend([name] * (name == "at"))
            return getattr(add, name)

    add = np.add
    monkeypatch.setattr(toxicity.np, "add", Add())
    for k, text in enumerate(("scum", "a b a b a", "one two three two one four " * 9, "x " * 40)):
        text, label = np.array(words.of(text)), float(k % 2)
        plain, plain_squares = copy.deepcopy(net), np.full_like(net.table, 1e-2)
        _plain_fit(plain, known, plain_squares, 0.3, text, label)
        squares = [np.full_like(w, 1e-2) for w in toxicity._weights(net)]
        own = copy.deepcopy(net)
        calls.clear()
        toxicity.fit(own, known, squares, 0.3, [text], np.array([label]), 1)
        assert len(calls) <= 1
        assert (own.table != net.table).any() and np.allclose(own.table, plain.table, atol=1e-5) and np.allclose(squares[0], plain_squares, atol=1e-5)
