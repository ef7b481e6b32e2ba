"""Group spelling variants of a corpus's words: reduced alphabet, one-edit neighbourhoods, checks on the words themselves.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so every
near word is met when the full one-edit neighbourhood of each reduced word (itself, deletions, replacements, insertions) is
joined with the reduced vocabulary; what is met is checked on the original words. Reduced words and their neighbours are
64-bit polynomial hashes, which are worked out from sums over a word's letters, so a word of any length costs its length
times the number of symbols; equal hashes of different strings only add candidates.

With fewer symbols neighbourhoods are small but more words share a reduced word. The alphabet is the smallest of
`ALPHABETS` for which the squares of the numbers of words per reduced word sum to at most `COLLISIONS` times the number of
words; the last one keeps all letters apart, so there is always one, and candidates stay in proportion to the vocabulary
whatever the words are. Nothing is capped.

Words are counted in the task that reads the text, in a table of bounded size, and summed by word after that. A word's form
is its commonest near word if that is at least `RATIO` times as common. Numbers rise along forms, so they make chains that
end; their ends are found by doubling, in as many rounds as the longest chain's length has binary digits.

Every join is a merge join by hint. Spark sizes what a task makes from a word by the word, so it would broadcast the
neighbourhoods, hundreds of rows a word, and the vocabulary by the size of its compressed file; both grow with the corpus.

Defined results: null and empty texts hold no words; a null id counts as the empty text where ids perturb words; repeated
rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.llm.common import prepare, stored

#: What a run of letters is (two more characters of the range are not letters, but count), and how words are perturbed.
LETTERS = "A-Za-zÀ-ÿ"
PERTURBED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2

ALPHABETS = (4, 6, 8, 12, 16, 24, 32, 64, 256)
COLLISIONS = 3
COUNTED_WORDS = 400_000
LONG_TEXT = 1 << 20
POSITIONS = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def perturbed(word: str, h: int) -> str:
    """The word, without one code point if the hash asks for it."""
    if h % PERTURBED:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: all words of `least_length` code points or more in all texts, with how often they occur."""
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a match is a whole run: repeats take all they can

    def runs(text: str) -> Counter:
        return Counter(run.findall(text) if len(text) < LONG_TEXT else (m.group() for m in run.finditer(text)))

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for letters, times in runs(text).items():
                    low = letters.encode().lower()  # of bytes: A-Z only
                    h = zlib.crc32(low, start)
                    word = low.decode() if h % PERTURBED else perturbed(low.decode(), h)
                    if len(word) >= least_length:
                        counts[word] += times
                if len(counts) > COUNTED_WORDS:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    pairs = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).mapInArrow(task, "word string, n long")
    return pairs.groupBy("word").agg(F.sum("n").alias("n"))


def symbols(size: int) -> np.ndarray:
    """The symbol, 1 to `size`, of each letter; all apart for 256."""
    letters = np.arange(256, dtype=np.uint64)
    return letters + np.uint64(1) if size >= 256 else (letters * np.uint64(0x9E3779B1) >> np.uint64(11)) % np.uint64(size) + np.uint64(1)


def reduced(word: Column, size: int) -> Column:
    """The reduced word as text."""
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
    return F.translate(word, "".join(letters), "".join(chr(0x100 + int(symbols(size)[ord(c)])) for c in letters))


def alphabet(words: DataFrame) -> int:
    """The smallest alphabet under which the words collide little."""
    total = words.count()
    for size in ALPHABETS[:-1]:
        shared = words.groupBy(reduced(F.col("word"), size).alias("code")).count()
        if (shared.agg(F.sum(F.col("count") * F.col("count")).alias("n")).first()["n"] or 0) <= COLLISIONS * total:
            return size
    return ALPHABETS[-1]


class Reduced:
    """Hashes of reduced words and of their neighbours."""

    def __init__(self, size: int):
        self.table, self.size = symbols(size), size
        self.powers = np.ones(1, np.uint64)

    def weights(self, n: int) -> np.ndarray:
        """Powers of the base from that of n - 1 down to 0."""
        if len(self.powers) < n:
            self.powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _BASE, np.uint64))))
        return self.powers[:n][::-1]

    def terms(self, word: str) -> np.ndarray:
        return self.table[np.frombuffer(word.encode("latin-1"), np.uint8)] * self.weights(len(word))

    def code(self, word: str) -> int:
        return int(self.terms(word).sum(dtype=np.uint64).view(np.int64))

    def neighbours(self, word: str) -> Iterator[np.ndarray]:
        """Hashes of everything up to one edit away, some maybe twice, in pieces by position."""
        terms, n = self.terms(word), len(word)
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        whole = before[-1]
        longer = self.weights(n + 1)
        every = np.arange(1, self.size + 1, dtype=np.uint64)[:, None]
        for a in range(0, n + 1, POSITIONS):
            z = min(a + POSITIONS, n + 1)
            here = slice(a, min(z, n))
            left = before[here]
            deleted = left * _BACK + (whole - left - terms[here])
            replaced = (whole - terms[here]) + every * longer[1:][here]
            inserted = before[a:z] * np.uint64(_BASE) + (whole - before[a:z]) + every * longer[a:z]
            yield np.unique(np.concatenate((before[-1:], deleted, replaced.ravel(), inserted.ravel())))


def neighbours(words: DataFrame, size: int) -> DataFrame:
    """wid, other: each word with the hashes of reduced words up to one edit from its own, of those from its own hash up:
    of two words whose reduced words differ, one has the other in its half."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Reduced(size)
        for b in batches:
            held, rows = [], 0
            for wid, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = of.code(word)
                for codes in of.neighbours(word):
                    codes = codes.view(np.int64)
                    held.append((wid, codes[codes >= own]))
                    rows += len(held[-1][1])
                    if rows > 200_000:
                        yield joined(held)
                        held, rows = [], 0
            yield joined(held)

    def joined(held: list) -> pa.RecordBatch:
        ids = np.repeat(np.array([w for w, _ in held], np.int64), [len(c) for _, c in held])
        codes = np.concatenate([c for _, c in held]) if held else np.zeros(0, np.int64)
        return pa.record_batch([pa.array(ids), pa.array(codes)], ["wid", "other"])

    return words.select("wid", "word").mapInArrow(task, "wid long, other long")


def coded(words: DataFrame, size: int) -> DataFrame:
    """code, wid, word, n: each word with the hash of its reduced word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Reduced(size)
        for b in batches:
            codes = pa.array([of.code(w) for w in b.column(1).to_pylist()], pa.int64())
            yield pa.record_batch([codes, b.column(0), b.column(1), b.column(2)], ["code", "wid", "word", "n"])

    return words.select("wid", "word", "n").mapInArrow(task, "code long, wid long, word string, n long")


def near_words(words: DataFrame, size: int) -> DataFrame:
    """wid, near_wid, near, near_n: every ordered pair of words exactly one edit apart. `words` has wid, word, n."""
    met = neighbours(words, size).join(coded(words, size).toDF("other", "near_wid", "near", "near_n").hint("merge"), "other")
    pairs = met.where("wid != near_wid").select("wid", "near_wid", "near", "near_n")
    checked = pairs.join(words.hint("merge"), "wid").where(F.levenshtein("word", "near", 1) == 1)
    both = F.explode(F.array(F.struct("wid", "near_wid", "near", "near_n"), F.struct(F.col("near_wid").alias("wid"), F.col("wid").alias("near_wid"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return checked.select(both.alias("p")).select("p.*").distinct()


def ends(links: DataFrame) -> DataFrame:
    """wid, to: for each link of a forest (wid, to), the last word reached."""
    links, moved = stored(links, "links"), True
    while moved:
        further = links.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        both = stored(links.join(further.hint("merge"), "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "links")
        links, moved = both.select("wid", "to"), not both.where("moved").isEmpty()
    return links


def variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of `counts` (word, n) with n of `least_count` or more."""
    prepare(counts.sparkSession)
    words = stored(counts.where(F.col("n") >= least_count).select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    pairs = near_words(words, alphabet(words))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"), F.col("near_wid")))
    found = stored(pairs.groupBy("wid").agg(F.count("*").alias("n_near"), best.alias("best")).select("wid", "n_near", (-F.col("best.n")).alias("near_n"), "best.near", "best.near_wid"), "near")
    named = words.join(found.hint("merge"), "wid", "left")
    has_form = F.col("near_n") >= ratio * F.col("n")
    last = ends(named.where(has_form).select("wid", F.col("near_wid").alias("to")))
    roots = last.join(words.select(F.col("wid").alias("to"), F.col("word").alias("root")).hint("merge"), "to").select("wid", "root")
    return named.join(roots.hint("merge"), "wid", "left").select(
        "word", F.when(has_form, F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("near_n")).alias("form_n"),
    )


def spelling(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The variants among the words of all texts."""
    return variants(count_words(docs, id_column, text_column))


def oracle_sql() -> str:
    """The same result from deletion neighbourhoods of the words themselves, for small tables."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(map(chr, range(0xC0, 0x100)))
    # one byte a letter, as the engine's edit distance counts bytes
    plain = "".join(chr(c) for c in range(33, 127) if chr(c) not in lower + "'")[: len(wide)]
    return f"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{upper}', '{lower}') AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
b AS (SELECT *, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) AS h FROM b),
p AS (SELECT CASE WHEN h % {PERTURBED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{wide}', '{plain}') AS t FROM p WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
k AS (SELECT word, n, t, unnest(list_distinct(list_concat([t], [substr(t, 1, i - 1) || substr(t, i + 1) FOR i IN range(1, length(t) + 1)]))) AS key FROM w),
c AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b USING (key) WHERE a.word <> b.word AND levenshtein(a.t, b.t) = 1),
m AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM c GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN m USING (word)),
u AS (SELECT word, word AS at FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON u.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, u.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN u USING (word) JOIN f AS e ON u.at = e.word WHERE e.form IS NULL
"""
