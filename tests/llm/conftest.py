import random

import pytest

#: Columns beyond id and text, some of them named like results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n int, id long, held_out int"


@pytest.fixture
def documents(spark):
    """A documents table from (id, text) or (id, text, lang) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, 0.5, "x", 3, 4, 5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture
def prose():
    """Made-up prose of n words from a seed."""

    def make(n, seed=0, syllables=("an", "the", "re", "on", "ti", "sh", "ou", "er")):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture
def odd_rows(prose):
    """Null and empty texts, null and repeated ids, ties, spaces only, a very long text, odd characters."""
    same = prose(40, 1)
    return [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (5, "  \t\n "), (None, prose(30, 2)), (None, None), (6, "word"),
        (7, prose(30_000, 3)), (8, "a" * 50_000), (9, "1" * 3000 + "." * 50 + "@" * 50), (10, "\U0001F600 é ß 中文\x00"), (11, same + " more"),
    ]
