import random
import zlib
from collections import Counter, defaultdict

import pytest

from askledger.llm import sharding


def plain_best_fit(sizes, capacity):
    """One group after the other into the fullest shard that holds it, the first of equal ones."""
    left, where = [], []
    for size in sizes:
        fitting = [(room, k) for k, room in enumerate(left) if room >= size]
        if fitting:
            k = min(fitting)[1]
        else:
            k = len(left)
            left.append(capacity)
        left[k] -= size
        where.append((size, k))
    return where, len(left)


def spelled_out(places):
    return [(size, first + k // each) for size, stretches in places.items() for begin, end, first, each in stretches for k in range(end - begin)]


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_in_bulk_is_best_fit_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([20, 100, 1000])
    counts = Counter(r.randint(1, r.choice([5, capacity // 2, capacity])) for _ in range(r.randint(1, 300)))
    falling = sorted(counts.items(), reverse=True)
    places, shards = sharding.best_fit(falling, capacity)
    where, wanted = plain_best_fit([s for s, n in falling for _ in range(n)], capacity)
    assert shards == wanted and Counter(spelled_out(places)) == Counter(where)
    assert (sharding.best_fit(falling, capacity, shards - 1) is None) and sharding.best_fit(falling, capacity, shards) == (places, shards)


@pytest.mark.parametrize("seed", range(20))
def test_even_shards(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 300) for _ in range(r.randint(0, 900)))
    if seed % 2:
        counts[r.randint(5_000, 90_000)] += r.randint(1, 3)
    falling = sorted(counts.items(), reverse=True)
    places = sharding.balanced(falling, 8)
    load = Counter()
    for size, k in spelled_out(places):
        assert 0 <= k < 8
        load[k] += size
    assert Counter(s for s, _ in spelled_out(places)) == counts
    total = sum(s * n for s, n in falling)
    if total > 30_000:
        shared = [load[k] for k in range(8) if load[k] < 5_000 or load[k] * 8 < total * 1.1]
        assert not shared or max(shared) - min(shared) <= 0.02 * max(shared) + 300


def test_rows_slots_and_groups(documents, odd_rows, prose):
    rows = odd_rows + [(100 + k, prose(3 + k % 50, k)) for k in range(300)] + [(1000 + k, "copied " * 30) for k in range(400)] + [(None, "copied " * 30)]
    found = sharding.digest(sharding.shard(documents(rows))).collect()
    texts = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, *texts(t)) for i, t in rows)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        of_text[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    load = Counter()
    for r in found:
        load[r.shard] += r.size
    large = {s for t, s in of_text.items() if t[0] > 40_000 or t[0] == 211 for s in s}
    small = [load[k] for k in range(8) if k not in large]
    assert max(small) - min(small) <= 60
    again = sharding.digest(sharding.shard(documents(rows))).collect()
    assert Counter((r.size, r.shard) for r in again) == Counter((r.size, r.shard) for r in found)
    assert sharding.shard(documents([])).collect() == []


def test_fixed_capacity(documents, prose):
    rows = [(k, prose(1 + k % 9, k)) for k in range(80)]
    found = sharding.shard(documents(rows), capacity=200).collect()
    load = Counter()
    for r in found:
        load[r.shard] += r.size
    groups = sorted((len(t.encode()) + 1 for t in {t for _, t in rows} for _ in [0]), reverse=True)
    by_text = Counter(t for _, t in rows)
    groups = sorted((n * (len(t.encode()) + 1) for t, n in by_text.items()), reverse=True)
    assert max(load.values()) <= 200 and len(load) == plain_best_fit(groups, 200)[1] and set(load) == set(range(len(load)))
    with pytest.raises(ValueError, match="larger than the capacity"):
        sharding.shard(documents([(1, "x" * 300)]), capacity=200)


def test_size_classes(spark):
    sizes = [1, 2, 4095, 8191, 8192, 8193, 8194, 16383, 16384, 16385, 10**12 + 7, 2**40]
    found = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", sharding.size_class(sharding.F.col("s"))).collect()
    for s, c in found:
        step = 1 << max(0, s.bit_length() - sharding.SIGNIFICANT)
        assert c == -(-s // step) * step
