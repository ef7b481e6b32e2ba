"""Text comparison forms, as Column -> Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: punctuation removed from both ends of a term, never from inside it.
EDGE_PUNCTUATION = " \t\r\n.,;:!?\"'`()[]{}<>|"
# Fixed value: quoting and separators that do not change what a query asks.
QUERY_NOISE = "[\"\u201c\u201d\u2018\u2019',;:()\\[\\]]+"

_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^/?#:\[\]]*))(?::[^/?#]*)?(?:[/?#]|$)"


def fold(text: Column) -> Column:
    """Case-insensitive form. Lower case, with the one common letter that folds to two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, _SPACE_RUN, " ")


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_long(text: Column) -> Column:
    """Like strip, for a column that may be long: its end is searched only if its last character is white space."""
    open_end = F.contains(F.lit(WHITESPACE), F.right(text, F.lit(1)))
    return F.when(open_end, strip(text)).otherwise(F.ltrim(text, F.lit(WHITESPACE)))


def is_blank(text: Column) -> Column:
    """True for a text of white space alone. Looked at from the left only, up to its first other character."""
    return F.ltrim(text, F.lit(WHITESPACE)) == ""


def same_text(text: Column) -> Column:
    """Form under which two answers or two fields count as equal."""
    return fold(F.trim(collapse(text)))


def term_text(text: Column) -> Column:
    """Form shared by personal-data terms and the queries they are masked in."""
    return fold(F.btrim(collapse(text), F.lit(EDGE_PUNCTUATION)))


def query_text(text: Column) -> Column:
    """Form under which two spellings of one search are equal. For comparison only."""
    return F.trim(collapse(fold(F.regexp_replace(text, QUERY_NOISE, " "))))


def is_null_word(text: Column) -> Column:
    """True when an answer is the word NULL; a missing answer is not."""
    bare = strip(text)
    # The length test spares long answers the change of case.
    return F.coalesce((F.length(bare) == 4) & (F.lower(bare) == "null"), F.lit(False))


def evidence_shape(text: Column) -> Column:
    """absent, empty, null or present. Only blanks are trimmed here."""
    bare = F.trim(text)
    return (
        F.when(text.isNull(), "absent")
        .when(bare == "", "empty")
        .when((F.length(bare) == 4) & (F.upper(bare) == "NULL"), "null")
        .otherwise("present")
    )


def block_evidence_shape(text: Column) -> Column:
    """Same four shapes for evidence as cut from prose: all white space is trimmed."""
    return evidence_shape(strip(text))


def is_scale(answer: Column) -> Column:
    """A 1-5 answer, alone or followed by something that is not a digit."""
    return answer.rlike(r"(?s)\A[1-5]([^0-9].*)?\z")


def is_three(answer: Column) -> Column:
    """The default scale answer, alone or followed by something that is not a digit."""
    return answer.rlike(r"(?s)\A3([^0-9].*)?\z")


def hostname(url: Column) -> Column:
    """Lower-case host of a URL; NULL when there is none."""
    host = F.coalesce(
        F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")),
        F.nullif(F.regexp_extract(url, _HOST, 2), F.lit("")),
    )
    return F.lower(host)


def capped_list(items: Column, limit: int | None = None) -> Column:
    """Comma list of an array; with a limit, the tail beyond it is replaced by its size."""
    texts = F.transform(items, lambda x: x.cast("string"))
    if limit is None:
        return F.array_join(texts, ", ")
    extra = F.size(texts) - F.lit(limit)
    return F.concat(
        F.array_join(F.slice(texts, 1, limit), ", "),
        F.when(extra > 0, F.format_string(", ... (+%d more)", extra)).otherwise(""),
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when whole is zero or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
