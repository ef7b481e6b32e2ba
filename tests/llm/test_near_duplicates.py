import random

import numpy as np

from askledger.llm import near_duplicates as nd
from askledger.llm import signatures as sig
from askledger.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    """Smallest id reachable over all pairs; ids are unique here."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, times, rng):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_matches_brute_force_with_chains_and_a_shared_passage(documents, prose):
    rng = random.Random(5)
    passage = prose(60, 99)
    rows, i = [], 100
    for base in range(12):
        text = prose(rng.choice([3, 8, 40, 150]), base)
        for _ in range(rng.randint(1, 9)):
            rows.append((i, text))
            text = edited(text, 1, rng) if rng.random() < 0.7 else text
            i -= 1
    hub = prose(120, 77)
    rows += [(1000 + k, edited(hub, rng.randint(0, 5), rng)) for k in range(60)]
    rows += [(2000 + k, passage + " " + prose(rng.randint(20, 90), 500 + k)) for k in range(40)]
    found = nd.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_odd_rows(documents, odd_rows):
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(documents(odd_rows)).collect()]
    assert len(found) == len(odd_rows)
    assert found.count((2, 36, 1, False)) == 2 and (1, 36, 1, True) in found and (11, 37, 1, False) in found
    for i in (3, 4, 5):
        assert (i, 0, i, True) in found
    assert (6, 1, 6, True) in found
    assert sorted((n, kept) for i, n, c, kept in found if i is None) == [(0, True), (26, True)]
    kept = nd.keep_one(documents(odd_rows))
    assert kept.columns == documents(odd_rows).columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10, None}


def test_empty(documents):
    assert nd.near_duplicates(documents([])).collect() == [] and nd.keep_one(documents([])).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    hub = [(7, k) for k in range(200, 260)]
    edges = spark.createDataFrame(path + hub + [(3, 3), (None, 4)], "a long, b long")
    from askledger.llm.common import shared_folder

    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    found = {r.id: r.component for r in components(edges).collect()}
    assert found == {**{k: 100 for k in range(101, 161)}, **{k: 7 for k in range(200, 260)}}


def test_estimate_is_close_to_the_jaccard_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((300, 0.8), (3000, 0.75), (3000, 0.3), (12, 0.8)):
        both = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, (n - len(both)) // 2).astype(np.uint64)))) for _ in range(2))
        a, b = np.sort(a * np.uint64(2)), np.sort(b * np.uint64(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = sig.registers([a, b])
        assert abs(sig.estimated_jaccard(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.13


def test_registers_hold_zeros_and_mantissa():
    h = np.array([(5 << 56) | (1 << 50) | (1 << 49), (6 << 56)], np.uint64)
    regs = sig.registers([h])[0]
    assert regs[5] == (5 << 10) + 512 + 1 and regs[6] > 0 and np.count_nonzero(regs) == 2
    assert (sig.filled(regs[None]) > 0).all()
