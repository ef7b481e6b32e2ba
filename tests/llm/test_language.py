from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askledger.llm import language

TONGUES = {"aa": ("an", "the", "re", "on"), "bb": ("ich", "ung", "ver", "zu"), "cc": ("eau", "qué", "oi", "vi")}


@pytest.fixture
def trained(documents, prose):
    rows = [(k, prose(60, k, TONGUES[t]), t) for k, t in enumerate(list(TONGUES) * 12)] + [(900, None, "aa"), (901, prose(60, 5), None), (902, "", "dd")]
    docs = documents(rows)
    return docs, rows, language.learn(docs, F.col("doc_id") % 4 != 2)


def test_held_out_rows(trained, documents, prose):
    _, _, profiles = trained
    fresh = [(k, prose(12 + k, 5000 + k, TONGUES[t]), t) for k, t in enumerate(list(TONGUES) * 10)]
    found = {r.doc_id: r for r in language.predict(documents(fresh), profiles).collect()}
    assert all(found[k].lang_pred == t and 0 <= found[k].score <= 1 for k, _, t in fresh)


def test_profiles_are_the_most_frequent_grams(trained):
    _, rows, profiles = trained
    from collections import Counter

    counted = Counter()
    for k, text, lang in rows:
        if lang == "bb" and k % 4 != 2:
            counted.update(language.letter_grams(text).tolist())
    best = [g for g, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
    column = profiles.places[:, profiles.languages.index("bb")]
    mine = sorted((p, g) for p, g in zip(column[:-1].tolist(), profiles.grams.tolist(), strict=True) if p < profiles.size)
    assert [g for _, g in mine] == best


def test_grams_of_a_text():
    grams = language.letter_grams("Ab, c")
    unpack = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0)).replace("\0", "")
    assert sorted(map(unpack, grams.tolist())) == sorted(["a", "b", "c", " a", "ab", "b ", " c", "c ", " ab", "ab ", " c "])


def test_odd_rows(trained, documents, odd_rows):
    _, _, profiles = trained
    found = language.predict(documents(odd_rows), profiles).collect()
    assert len(found) == len(odd_rows)
    assert {(r.lang_pred, r.score) for r in found if r.doc_id in (3, 4, 5, 9)} == {("und", 0.0)} and all(r.lang_pred != "und" for r in found if r.doc_id in (1, 2, 7))
    kept = language.keep_known(documents(odd_rows), profiles, 0.0)
    assert kept.columns == documents(odd_rows).columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, 8, 10, 11, None}


def test_nothing_to_learn_from(documents):
    profiles = language.learn(documents([(1, "abc")]), F.lit(True))
    assert [(r.lang_pred, r.score) for r in language.predict(documents([(1, "abc")]), profiles).collect()] == [("und", 0.0)]
    assert language.predict(documents([]), profiles).collect() == []


def test_most_frequent_by_count_then_value(monkeypatch):
    """As defined, for every size; equal values are sorted once, by no general routine."""
    rng = np.random.default_rng(2)
    monkeypatch.delattr(language.np, "unique")
    for n in (0, 1, 2, 50, 3000):
        grams = rng.zipf(1.5, n) % (1 << 62)
        counts = Counter(grams.tolist())
        plain = sorted(counts, key=lambda g: (-counts[g], g))
        for size in (1, 7, len(plain), len(plain) + 1):
            assert language.most_frequent(grams, size).tolist() == plain[:size]
