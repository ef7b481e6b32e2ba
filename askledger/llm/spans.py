"""Spans as columns: where a regular expression matches, how spans are written, how text is rewritten around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end in code points (end exclusive), order: place of the kind in its list.
SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"


def matches(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost, not overlapping matches of a whole text; those whose group `group` is shorter than `least` are dropped.

    Splitting by the same expression gives the stretches between the matches, so lengths alone give the places.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else hits
    none = F.lit(None).cast(SPAN)
    empty = F.coalesce(none, F.array().cast(SPAN))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gaps"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (start + x["hits"]).alias("end"))
        kept = F.when(F.coalesce(x["values"], F.lit(0)) >= least, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + x["hits"]).alias("at"), kept.alias("spans"))

    zipped = F.filter(F.arrays_zip(gaps.alias("gaps"), hits.alias("hits"), values.alias("values")), lambda x: x["hits"].isNotNull())
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def written(spans: Column) -> Column:
    """kind:start:end of all spans by start, then order of kinds, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def rewritten(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap, the first one names the whole."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), kept.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
