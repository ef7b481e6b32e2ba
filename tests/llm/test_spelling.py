import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from askledger.llm import spelling


def near(a, b):
    """Whether two words are exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    form, close = {}, {}
    for w in n:
        close[w] = [v for v in n if near(w, v)]
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def texts(seed):
    """Few letters, so that many words are near; chains of forms; letters beyond A-Z; repeats."""
    r = random.Random(seed)
    words = ["".join(r.choice("abéÉ×") for _ in range(r.randint(4, 7))) for _ in range(60)]
    chain = [("grande", 40), ("grandes", 20), ("grandest", 9), ("grandests", 4)]
    rows = [(k, " ".join(r.choices(words, k=120)) + ".") for k in range(12)]
    rows += [(100 + k, " ".join(w.upper() if j % 2 else w for w, c in chain for j in range(c) if j % 3 == k)) for k in range(3)]
    return rows


def test_against_all_pairs(documents, odd_rows):
    rows = texts(1) + odd_rows + [(50 + k, "z" * 40_000 + ("" if k % 2 else "y")) for k in range(8)]
    found = sorted(tuple(r) for r in spelling.spelling(documents(rows)).collect())
    assert found == brute_force(rows)
    assert any(r[1] and r[2] != r[1] for r in found) and {len(r[0]) for r in found} >= {40_000, 40_001}
    assert spelling.spelling(documents([])).collect() == []


def test_sql_agrees(documents, tmp_path):
    rows = texts(2) + [(k, "Éclair éclair Éclairs Straße strasse " * 3) for k in range(200, 260)] + [(None, "nulls nulls nulls"), (1, None), (2, "")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(spelling.oracle_sql()).fetchall()) == brute_force(rows)


@pytest.mark.parametrize("size", spelling.ALPHABETS)
def test_every_near_word_is_met(size):
    r = random.Random(size)
    of = spelling.Reduced(size)
    for _ in range(40):
        word = "".join(r.choice("abcdefghijklmnopqrstuvwxyzéÿ") for _ in range(r.randint(1, 12)))
        k, c = r.randrange(len(word)), r.choice("qéÀ")
        met = np.concatenate([x.view(np.int64) for x in of.neighbours(word)])
        for other in (word, word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :], word[:k] + c + word[k:], word + c):
            assert of.code(other) in met


def test_the_alphabet_grows_where_words_collide(spark):
    letters = "abcdefghijklmnop"
    same = [a + b + c + "xyz" for a in letters for b in letters for c in letters]
    few = spark.createDataFrame([(k, w, 3) for k, w in enumerate(same)], "wid long, word string, n long")
    size = spelling.alphabet(few)
    assert size > spelling.ALPHABETS[0]
    assert spelling.near_words(few, size).count() == len(same) * 45


def test_nothing_that_grows_is_broadcast(spark, documents, capsys, tmp_path):
    """Neighbourhoods look as small as the words they are made from; small as these tables are, no join may send one to the driver."""
    words = spark.createDataFrame([(k, f"word{chr(97 + k)}x", 3) for k in range(20)], "wid long, word string, n long")
    words.write.parquet(path := f"{tmp_path}/words")
    for found in (spelling.near_words(spark.read.parquet(path), 4), spelling.spelling(documents(texts(3)))):
        assert found.collect()
        found.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
