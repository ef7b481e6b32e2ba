"""Reading question and answer prose with regular expressions, inside the JVM.

Fixed values: the patterns below state the two prose shapes. `\\z` is the end of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from askledger.functions import text as tx

QUESTION = r"(?sU)Q([0-9]+)\.\s*(.*?)(?=\nQ[0-9]+\.|\z)"

_EVIDENCE = r"(?:\n+Evidence[.:]?[ \t]*(.*?))"
_LABEL = r"\n+Evidence[.:]?[ \t]*"
# Shape 1 repeats each question before its answer; blocks are parted by a blank line.
_ECHO = r"Q([0-9]+)\..*?\nA\1\.[ \t]*(.*?)"
_ECHO_END = r"(?=\n\s*\nQ[0-9]+\.|\z)"
# Shape 2 has the answers alone, one under the other.
_BARE = r"^A([0-9]+)\.[ \t]*(.*?)"
_BARE_END = r"(?=\n\s*A[0-9]+\.|\z)"

CITATION = r"\(\[([^\]]*)\]\(([^)]*)\)\)"

SHAPES = {
    # flags, head, end
    "q_echo": ("(?s)", _ECHO, _ECHO_END),
    "bare": ("(?sm)", _BARE, _BARE_END),
}


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once. The list of one binds it to a name: as an expression, it would be
    computed again in each place, and in an inner lambda for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def questions(prompt: Column) -> Column:
    """array<struct<qnum, text>> of a prompt, by number; a repeated number keeps its last text."""
    found = F.arrays_zip(
        F.regexp_extract_all(prompt, F.lit(QUESTION), F.lit(1)).alias("n"),
        F.regexp_extract_all(prompt, F.lit(QUESTION), F.lit(2)).alias("t"),
    )
    numbered = F.transform(
        found,
        lambda q, i: F.struct(
            _number(q["n"]).alias("qnum"), i.alias("pos"), tx.strip(q["t"]).alias("text")
        ),
    )
    return F.transform(
        last_of_each(F.filter(numbered, lambda q: q["qnum"].isNotNull())),
        lambda q: F.struct(q["qnum"].alias("qnum"), q["text"].alias("text")),
    )


def last_of_each(items: Column) -> Column:
    """Of structs (qnum, pos, ...), the one with the highest pos per qnum, ordered by qnum."""

    def pick(ordered: Column) -> Column:
        return F.filter(
            ordered, lambda x, i: ~F.coalesce(F.get(ordered, i + 1)["qnum"] == x["qnum"], F.lit(False))
        )

    return _once(F.sort_array(items), pick)


def starts(parts: Column, whole: Column, offset: Column | None = None) -> Column:
    """0-based position of each part in `whole`; parts are in order and do not overlap."""
    state = F.struct(
        F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")
    )

    def step(acc: Column, part: Column) -> Column:
        here = F.call_function("locate", part, whole, acc["at"])
        return F.struct(
            (here + F.length(part)).alias("at"),
            F.concat(acc["found"], F.array(here - 1)).alias("found"),
        )

    return F.aggregate(parts, state, step, lambda acc: acc["found"])


def _blocks_of(text: Column, shape: str) -> Column:
    flags, head, end = SHAPES[shape]
    found = F.regexp_extract_all(text, F.lit(flags + head + _EVIDENCE + "?" + end), F.lit(0))
    placed = _once(found, lambda parts: F.arrays_zip(parts.alias("block"), starts(parts, text).alias("at")))
    # A block up to where its evidence label, or nothing more, follows, and then with the label. Only this top of a block
    # is read by further patterns: long evidence is read once.
    lead = flags + r"\A" + head.removeprefix("^") + r"(?=\n+Evidence|\z)"
    opened = F.transform(
        placed,
        lambda b: F.struct(
            b["block"].alias("block"), b["at"].alias("at"), F.regexp_extract(b["block"], f"{lead}(?:{_LABEL})?", 0).alias("top")
        ),
    )
    cut = F.transform(
        opened,
        lambda b: F.struct(
            b.alias("b"),
            _number(F.regexp_extract(b["top"], lead, 1)).alias("qnum"),
            tx.strip(F.regexp_extract(b["top"], lead, 2)).alias("answer"),
            F.length(F.regexp_extract(b["top"], lead, 0)).alias("lead"),
            F.length(b["top"]).alias("size"),
        ),
    )

    def finished(x: Column) -> Column:
        # Nothing left over: no label, evidence is NULL. A label alone: evidence is ''.
        left = (x["lead"] < x["size"]) | (x["b"]["block"] != x["b"]["top"])
        return F.struct(
            x["qnum"].alias("qnum"),
            x["answer"].alias("answer"),
            F.when(left, F.substr(x["b"]["block"], x["size"] + 1)).alias("evidence"),
            F.when(left, x["b"]["at"] + x["size"]).alias("evidence_start"),
            F.lit(shape).alias("shape"),
        )

    return F.transform(cut, finished)


def echo_blocks(text: Column) -> Column:
    """Blocks of the shape that repeats the questions."""
    return _blocks_of(text, "q_echo")


def bare_blocks(text: Column) -> Column:
    """Blocks of the shape that has answers only."""
    return _blocks_of(text, "bare")


def answer_blocks(text: Column) -> Column:
    """array of blocks (qnum, answer, evidence, evidence_start, shape) of one run's prose.

    Evidence is NULL when its label is absent and '' when the label stands alone. The bare shape
    is tried only when no question is echoed at all.
    """
    echo = echo_blocks(text)
    return F.when(F.size(echo) > 0, echo).otherwise(bare_blocks(text))


def block_citations(block: Column) -> Column:
    """Links in a block's evidence: qnum, url, title, and position in the run's text."""
    evidence = block["evidence"]
    # The evidence is searched once; title and address are then read from the short links.
    placed = _once(
        F.regexp_extract_all(evidence, F.lit(CITATION), F.lit(0)),
        lambda links: F.arrays_zip(links.alias("link"), starts(links, evidence).alias("at")),
    )
    opened = F.transform(
        placed,
        lambda c: F.struct(
            F.regexp_extract(c["link"], CITATION, 1).alias("title"),
            F.regexp_extract(c["link"], CITATION, 2).alias("url"),
            c["at"].alias("at"),
        ),
    )
    return F.transform(
        opened,
        lambda c: F.struct(
            block["qnum"].alias("qnum"),
            F.nullif(c["url"], F.lit("")).alias("url"),
            F.nullif(c["title"], F.lit("")).alias("title"),
            ((c["title"] == "") & (c["url"] == "")).alias("empty_placeholder"),
            (block["evidence_start"] + c["at"]).alias("char_pos"),
        ),
    )


def prose_citations(blocks: Column) -> Column:
    """All links inside the evidence of the blocks."""
    return F.flatten(
        F.transform(F.filter(blocks, lambda b: b["evidence"].isNotNull()), block_citations)
    )


def count_citations(text: Column) -> Column:
    """Links anywhere in a text."""
    return F.regexp_count(text, F.lit(CITATION))
