import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askledger.llm import language_model as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_base_scores_match_brute_force(documents, prose, odd_rows, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(100 + k, prose(20 + k, k)) for k in range(60)] + [r for r in odd_rows if r[0] != 8]
    held = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(True))
    docs = documents(rows)
    found = lm.score(docs, held, lm.train(docs, ~held)).collect()
    counts = Counter(t for i, text in rows if i is not None and i % 10 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.held_out == (r.doc_id is None or r.doc_id % 10 == 0) and r.score < 0 for r in found)


def test_filter_keeps_levels():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    level = rng.integers(1, 6, 4000)
    bits, segments = 1 << 16, 4
    there = np.zeros((segments, bits), bool)
    for k in range(1, 6):
        own = hashes[level >= k]
        for place in lm.Filter.places(own, k, bits):
            there[lm.Filter.segment_of(own, segments).astype(int), place.astype(int)] = True
    f = lm.Filter(np.packbits(there.reshape(-1), bitorder="little"), bits, segments)
    assert (f.levels(hashes) >= level).all() and (f.levels(hashes) == level).mean() > 0.9
    assert (f.levels(rng.integers(0, 2**63, 4000).astype(np.uint64)) == 0).mean() > 0.9


def test_scores_follow_the_corpus(documents):
    rows = [(k, "the cat sat on the mat") for k in range(1, 10)] + [(10, "mat the on sat cat the"), (20, "the cat sat on the mat"), (30, "quite other words here at all")]
    held = F.col("doc_id") % 10 == 0
    docs = documents(rows)
    s = {r.doc_id: r.score for r in lm.score(docs, held, lm.train(docs, ~held)).collect()}
    assert s[20] > s[10] > s[30] and s[20] == pytest.approx(s[1])


def test_nothing_to_learn_from(documents):
    held = F.lit(True)
    docs = documents([(1, "a b"), (2, None)])
    found = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs, held, lm.train(docs, ~held)).collect()}
    assert found == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert lm.score(documents([]), held, lm.train(documents([]), ~held)).collect() == []


@pytest.mark.parametrize("n", [20_000, 320_000])
def test_error_rate_does_not_grow_with_the_ngrams(n):
    rng = np.random.default_rng(3)
    local, unseen = rng.integers(0, 2**32, n).astype(np.uint32), rng.integers(0, 2**32, 50_000).astype(np.uint64)
    f = lm.Filter.of_counts(local, rng.geometric(0.6, n))
    assert (f.levels(local.astype(np.uint64)) >= 1).all() and (f.levels(unseen) > 0).mean() < 0.02


def test_filter_grows_with_the_corpus_and_is_not_collected(documents, prose, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 10)
    rows = [(k, prose(400, k, tuple("bcdfghklmn"))) for k in range(1, 60)]
    docs = documents(rows)
    model = lm.train(docs, F.lit(True))
    grams = {w for _, t in rows for w in tokens(t)} | {(a, b) for _, t in rows for a, b in zip([0, *tokens(t)[:-1]], tokens(t), strict=True)}
    assert model.segments > 16 and sum(8 * len(r.bits) for r in model.filter.collect()) >= lm.BITS * len(grams)
    assert len(lm.score(docs, F.lit(False), model).collect()) == len(rows)
