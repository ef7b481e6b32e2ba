"""Secrets in texts: regular expressions behind a trigram inverted index. DataFrame functions only.

Every rule's expression gives a Boolean trigram query. The index lists, for each trigram any query asks for, the documents
whose folded text holds it. It is partitioned by document: a row carries its own postings, so intersecting the lists of a
query is a test within the row and needs no shuffle; `inverted_index` gives the same postings as a table. Only documents
that a rule's query leaves are searched with its expression; a rule without mandatory trigrams searches all.

Defined results: a null text is empty and has no spans; a null or repeated id is carried along, each row for itself; an
empty table gives no rows; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.llm import spans
from askledger.llm.trigrams import query


@dataclass(frozen=True)
class Rule:
    """Matches count if their group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. Their runs are maximal, so lengths can stand in the last two expressions.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Published formats of further credentials.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("browser", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"[a-z]{2,12}://[^\s:@/]+:[^\s:@/]+@"),
)
RULES = BASE + MORE


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that some rule's query asks for."""
    return sorted({t for r in rules for alternative in query(r.pattern) or () for t in alternative})


def with_postings(docs: DataFrame, trigrams: list[str], text: str, name: str = "postings") -> DataFrame:
    """Each row with the places in `trigrams` of those that its text holds: its part of the inverted index."""
    if not trigrams:
        return docs.withColumn(name, F.array().cast("array<int>"))
    folded = f"{name}_text"
    fold = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    there = [F.when(F.contains(folded, F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]
    return docs.withColumn(folded, fold).withColumn(name, F.array_compact(F.array(*there))).drop(folded)


def inverted_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """trigram, doc_id: the posting lists of all trigrams the rules ask for."""
    trigrams = vocabulary(rules)
    named = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    lists = with_postings(named, trigrams, "text").select("doc_id", F.explode("postings").alias("k"))
    return lists.select(F.element_at(F.lit(trigrams), F.col("k") + 1).alias("trigram"), "doc_id") if trigrams else lists.select(F.lit("").alias("trigram"), "doc_id")


def may_match(rule: Rule, trigrams: list[str], postings: Column) -> Column:
    """The rule's Boolean query over a row's postings."""
    wanted = query(rule.pattern)
    if wanted is None:
        return F.lit(True)
    every = lambda alternative: reduce(lambda a, b: a & b, [F.array_contains(postings, trigrams.index(t)) for t in sorted(alternative)])
    return reduce(lambda a, b: a | b, [every(a) for a in wanted])


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with column `name`, worked out once a row. A generator of one row keeps the optimizer from writing the whole
    expression again into each place of a later expression that names the column."""
    return df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...], text: str, name: str = "spans") -> DataFrame:
    """Each row with the spans of all rules in its whole text, in the order of rules."""
    trigrams = vocabulary(rules)
    postings = f"{name}_postings"
    none = F.array().cast(spans.SPAN)
    found = [
        F.when(may_match(r, trigrams, F.col(postings)), spans.matches(F.col(text), r.pattern, r.kind, k, r.group, r.least)).otherwise(none)
        for k, r in enumerate(rules)
    ]
    return settled(with_postings(docs, trigrams, text, postings), name, F.concat(*found)).drop(postings)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (array of start, order, kind, end) for every row."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return with_spans(named, rules, "text").select("doc_id", "spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the base rules' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    counts = [spans.count(base, r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(spans.written(base), 256).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by its kind in brackets; a length column follows its text."""
    found = with_spans(docs.withColumn("_text", F.coalesce(text_column, F.lit(""))), rules, "_text", "_spans")
    hit = F.size("_spans") > 0
    clean = F.when(hit, spans.rewritten(F.col("_text"), F.col("_spans"))).otherwise(F.col(text_column))
    changed = settled(found, text_column, clean)
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        changed = changed.withColumn(length_column, F.when(hit, F.length(text_column).cast(kind)).otherwise(F.col(length_column)))
    return changed.select(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result from the expressions alone, without an index."""

    def of(k: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        value = f"length(regexp_extract_all(t, '{p}', {r.group})[i])" if r.group else "length(hits[i])"
        return f"""SELECT doc_id, row, {k} AS ord, '{r.kind}' AS kind, s AS start, s + length(hits[i]) AS stop FROM (
          SELECT doc_id, row, t, i, hits, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS s
          FROM (SELECT doc_id, row, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
                FROM (SELECT doc_id, row, t, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d)))
          WHERE {value} >= {r.least}"""

    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE)
    text = "kind || ':' || start || ':' || stop"
    base = f"coalesce(string_agg({text}, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}), '')"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
      f AS ({' UNION ALL '.join(of(k, r) for k, r in enumerate(rules))})
      SELECT d.doc_id, {counts}, sha256({base}) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY start, ord), '') AS spans
      FROM d LEFT JOIN f USING (row) GROUP BY d.row, d.doc_id"""
