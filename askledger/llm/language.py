"""Language identification by rank-order n-gram profiles.

A profile is a list of the most frequent letter n-grams, one to three long, most frequent first (ties: smaller code
points first). A document's own list is compared with each language's list by the out-of-place distance: the sum over
the document's n-grams of how far each stands from its place in the language's list, `PROFILE` if it is not there. The
nearest language wins; equal distances go to the smaller name.

Text is lower-cased; a run of anything but letters becomes one space, which also stands before the first and after the
last word; no n-gram reaches over a space. Three code points fit one 63-bit number, so n-grams are exact.

Profiles are learned from at most about `training_rows` documents a language, chosen by a hash of the id: a documented
bound on labelled rows, not on what is predicted. Predictions see whole texts and nothing else.

Defined results: a text that is null or has no letters is `und` with score 0, and so is everything if nothing was
learned from; rows with a null language are not learned from; a null or repeated id is carried along; other columns are
ignored. The score is 1 - distance / largest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
TRAINING_ROWS = 4000
MAX_LANGUAGES = 1000
UNKNOWN = "und"

_BITS = 21
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """A table over code points, made once in each Python process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers, repeats included; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others, the first
    c = np.empty(int(keep.sum()) + 2, np.int64)
    c[0], c[1:-1], c[-1] = 32, points[keep], 32
    if c[-2] == 32:
        c = c[:-1]
    one = c[c != 32]
    two = c[:-1] << _BITS | c[1:]
    three = (two[:-1] << _BITS | c[2:])[c[1:-1] != 32]
    return np.concatenate((one, two, three))


def most_frequent(grams: np.ndarray, size: int) -> np.ndarray:
    if not len(grams):
        return grams
    grams = np.sort(grams)
    ends = np.flatnonzero(np.concatenate((grams[1:] != grams[:-1], [True])))
    # count and place as one number: the most frequent first, of equals the smaller
    ranked = np.arange(len(ends)) - (np.diff(ends, prepend=-1) << 32)
    if len(ranked) > size:
        ranked = np.partition(ranked, size)[:size]
    ranked.sort()
    return grams[ends[ranked & 0xFFFFFFFF]]


@dataclass
class Profiles:
    """Languages in order of name; for each known n-gram its place in every language's list."""

    languages: list[str]
    grams: np.ndarray
    places: np.ndarray
    size: int

    @classmethod
    def of(cls, lists: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(lists)
        grams = np.unique(np.array([g for x in lists.values() for g in x], np.int64))
        places = np.full((len(grams) + 1, len(languages)), size, np.int32)  # the last row: not in any list
        for k, name in enumerate(languages):
            places[np.searchsorted(grams, lists[name]), k] = np.arange(len(lists[name]))
        return cls(languages, grams, places, size)

    def nearest(self, text: str | None) -> tuple[str, float]:
        found = most_frequent(letter_grams(text or ""), self.size)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, found)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != found] = len(self.grams)
        places = self.places[at]
        own = np.arange(len(found), dtype=np.int32)[:, None]
        away = np.where(places == self.size, self.size, np.abs(places - own)).sum(0)
        best = int(away.argmin())
        return self.languages[best], 1.0 - float(away[best]) / (self.size * len(found))


def learn(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", size: int = PROFILE, training_rows: int = TRAINING_ROWS) -> Profiles:
    """Profiles of all languages among the rows where `usable` holds."""
    named = docs.where(usable).select(
        F.col(language_column).alias("language"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column)).alias("draw")
    ).where("language IS NOT NULL AND text IS NOT NULL")
    there = named.groupBy("language").count().limit(MAX_LANGUAGES + 1).collect()
    if len(there) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {language_column} a language?")
    if not there:
        return Profiles.of({}, size)
    share = F.create_map(*[F.lit(x) for r in there for x in (r["language"], min(1.0, training_rows / r["count"]))])
    drawn = named.where(F.pmod("draw", F.lit(1 << 20)) < share[F.col("language")] * (1 << 20))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list[np.ndarray]] = {}
            for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.setdefault(language, []).append(letter_grams(text))
            for language, grams in rows.items():
                values, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.record_batch([pa.array([language] * len(values), pa.string()), pa.array(values), pa.array(n)], ["language", "gram", "n"])

    summed = drawn.select("language", "text").mapInArrow(counts, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list[int]] = {}
    for r in summed.withColumn("place", place).where(F.col("place") <= size).orderBy("language", "place").collect():
        lists.setdefault(r["language"], []).append(r["gram"])
    return Profiles.of(lists, size)


def predict(docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.nearest(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(task, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least_score: float, text_column: str = "text") -> DataFrame:
    """The rows, all columns kept, whose text is near some profile: not `und`, and scored `least_score` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.nearest(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([x[0] != UNKNOWN and x[1] >= least_score for x in found], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
