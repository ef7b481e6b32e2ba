"""Masking personal data in query text, and the templates that remain.

A query is compared with the terms of its own entity only. The join is an equi-join on the
entity, the comparison happens inside the joined row, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.operators import anomaly as an
from askledger.sources.staging import staged

# The fields a term can belong to.
FIELDS = ("name", "street", "city", "zip", "phone", "email", "owner")
# Size of the head for coverage, rows of the head export, shortest near-miss word.
HEAD_FOR_COVERAGE = 100
HEAD_EXPORT = 200
MIN_WORD = 4
THIN_HEAD = 0.5

# Terms in one packed row at most, about: an entity with more has several rows.
PACKED_TERMS = 1024


def placeholder(field: Column) -> Column:
    """<NAME> for name. Upper case, so that no folded term can match inside it."""
    return F.concat(F.lit("<"), F.upper(field), F.lit(">"))


def pack_terms(terms: DataFrame, limit: int = PACKED_TERMS) -> DataFrame:
    """Term arrays per entity: se10, n_parts, terms. An entity has one row for every `limit` distinct terms."""
    term = F.struct((-F.length("value_norm")).alias("rank"), "value_norm", "field")
    known = terms.filter("value_norm <> '' and se10 is not null").select("se10", term.alias("term")).distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy("se10"))
    return (
        known.withColumn("n_parts", F.ceil(size / F.lit(limit)).cast("int"))
        .groupBy("se10", "n_parts", F.pmod(F.xxhash64("term"), F.col("n_parts")).alias("part"))
        .agg(F.collect_list("term").alias("terms"))
        .drop("part")
    )


def attach_hits(
    queries: DataFrame, terms: DataFrame, text: Column, row_key: Sequence[str], limit: int = PACKED_TERMS
) -> DataFrame:
    """Queries with `_text`, the own entity's terms found in it (`_hits`) and `_has_terms`.

    Hits are ordered longest first, then by value and field. The packed terms are written once, so the joins need no
    memory for packing. Queries meet them in one join; a hot entity is split there by Spark's own skew handling. Only
    queries of an entity with several parts go through a join of their own and are put together again by `row_key`, which
    must identify a query; no entity is ever collected whole.
    """
    packed = staged(pack_terms(terms, limit))
    found = F.filter("terms", lambda t: F.contains(F.col("_text"), t["value_norm"]))
    keep = [*queries.columns, "_text"]
    single = packed.withColumn("terms", F.when(F.col("n_parts") == 1, F.col("terms")))
    # The text is folded after the join: one form of it moves, and where the joined rows are, not where the scan has them.
    whole = (
        queries.join(single, "se10", "left")
        .filter("n_parts is null or n_parts = 1")
        .withColumn("_text", text)
        .select(*keep, F.sort_array(F.coalesce(found, F.array())).alias("_hits"), F.col("n_parts").isNotNull().alias("_has_terms"))
    )
    rest = [c for c in keep if c not in row_key]
    by_parts = (
        queries.join(packed.filter("n_parts > 1"), "se10")
        .withColumn("_text", text)
        .select(*keep, found.alias("_hits"))
        .groupBy(*row_key)
        .agg(
            *[F.any_value(c).alias(c) for c in rest],
            F.sort_array(F.flatten(F.collect_list("_hits"))).alias("_hits"),
        )
        .select(*keep, "_hits", F.lit(True).alias("_has_terms"))
    )
    return whole.unionByName(by_parts)


def mask_text(text: Column, hits: Column) -> Column:
    """struct(template, n_placeholders): every occurrence of every hit replaced, in order."""
    start = F.struct(text.alias("s"), F.lit(0).alias("n"))

    def replace_one(done: Column, term: Column) -> Column:
        value = term["value_norm"]
        gone = F.length(done["s"]) - F.length(F.replace(done["s"], value, F.lit("")))
        return F.struct(
            F.replace(done["s"], value, placeholder(term["field"])).alias("s"),
            (done["n"] + F.floor(gone / F.length(value)).cast("int")).alias("n"),
        )

    return F.aggregate(hits, start, replace_one)


def mask_queries(
    queries: DataFrame,
    terms: DataFrame,
    groups: DataFrame,
    row_key: Sequence[str],
    **options,
) -> DataFrame:
    """Queries with template, number of placeholders and archetype.

    `groups` is the hand-kept (template, archetype) list.
    """
    masked = attach_hits(
        queries.drop("template", "n_placeholders", "archetype"),
        terms, tx.term_text(F.col("query_text")), row_key, **options,
    ).withColumn("_m", mask_text(F.col("_text"), F.col("_hits")))
    templated = masked.select(
        *[c for c in queries.columns if c not in ("template", "n_placeholders", "archetype")],
        F.col("_m.s").alias("template"),
        F.col("_m.n").alias("n_placeholders"),
        F.col("_has_terms").alias("has_terms"),
    )
    return templated.join(groups.select("template", "archetype"), "template", "left")


def unmatched_groups(masked: DataFrame, groups: DataFrame) -> DataFrame:
    """Hand-kept groupings that no query has."""
    return groups.join(masked.select("template").distinct(), "template", "left_anti")


def unmaskable(masked: DataFrame, merchants: DataFrame) -> DataFrame:
    """Entities without terms: how many queries stay as they are, and is the entity known."""
    return (
        masked.filter("not has_terms")
        .groupBy("se10")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .join(
            merchants.select("se10").distinct().withColumn("known", F.lit(True)), "se10", "left"
        )
        .select("se10", "n_rows", F.coalesce("known", F.lit(False)).alias("has_merchant"))
    )


def masking_anomalies(masked: DataFrame, groups: DataFrame, merchants: DataFrame) -> DataFrame:
    """ARCHETYPE_GROUP_UNMATCHED and TEMPLATE_NO_PII_TERMS."""
    why = F.when(F.col("has_merchant"), "has a merchants row, but it gave no terms").otherwise(
        "is absent from input"
    )
    return an.union_all(
        [
            an.anomaly(
                unmatched_groups(masked, groups), "analyze", "ARCHETYPE_GROUP_UNMATCHED",
                F.format_string("archetype %s groups a template that no query has", "archetype"),
            ),
            an.anomaly(
                unmaskable(masked, merchants), "analyze", "TEMPLATE_NO_PII_TERMS",
                F.format_string("%d queries of se10 %s stay verbatim: it %s", "n_rows", "se10", why),
            ),
        ]
    )


def mask_counters(masked: DataFrame, groups: DataFrame) -> DataFrame:
    """Counters of one masking pass. One row."""
    zero = F.lit(0).cast("bigint")
    none = ~F.col("has_terms")
    rows = masked.groupBy("se10").agg(
        F.count(F.lit(1)).alias("tmpl_rows"),
        F.count_if(F.col("n_placeholders") > 0).alias("tmpl_masked"),
        F.count_if(F.col("n_placeholders") == 0).alias("tmpl_unmasked"),
        F.max(none.cast("bigint")).alias("tmpl_no_terms_entities"),
        F.count_if(none).alias("tmpl_no_terms_rows"),
    ).drop("se10")
    names = [*rows.columns, "tmpl_group_rows", "tmpl_group_unmatched"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("_n")).select(
            *[(F.col("_n") if c == name else zero).alias(c) for c in names]
        )

    return (
        rows.withColumns({c: zero for c in names[-2:]})
        .unionByName(side(groups, "tmpl_group_rows"))
        .unionByName(side(unmatched_groups(masked, groups), "tmpl_group_unmatched"))
        .agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in names])
    )


def archetype_rollup(masked: DataFrame) -> DataFrame:
    """One row per archetype, or per template where none is given."""
    return (
        masked.filter("template is not null")
        .groupBy(F.coalesce("archetype", "template").alias("archetype_id"))
        .agg(
            F.min("query_text").alias("exemplar"),
            F.count(F.lit(1)).alias("n_queries"),
            F.countDistinct("se10").alias("n_merchants"),
            F.count_if(F.col("is_billed_query")).alias("n_billed_calls"),
            F.bool_or(F.col("archetype").isNull()).alias("is_unmapped"),
        )
    )


def masking_totals(masked: DataFrame) -> DataFrame:
    """How much was templated, masked and mapped. One row."""
    billed, bare = F.col("is_billed_query"), F.col("n_placeholders") == 0
    return masked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("template").alias("n_templated"),
        F.count_if(billed).alias("n_billed"),
        F.count_if(bare).alias("n_unmasked"),
        F.count_if(bare & billed).alias("n_unmasked_billed"),
        F.count_if(F.col("archetype").isNotNull() & billed).alias("n_mapped_billed"),
        F.countDistinct("archetype").alias("n_groups"),
    ).withColumns(
        {
            "unmasked_share": tx.ratio(F.col("n_unmasked_billed"), F.col("n_billed")),
            "mapped_share": tx.ratio(F.col("n_mapped_billed"), F.col("n_billed")),
        }
    )


def billed_templates(masked: DataFrame) -> DataFrame:
    """Billed queries per template."""
    return (
        masked.filter("template is not null and is_billed_query")
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def head_coverage(masked: DataFrame, head: int = HEAD_FOR_COVERAGE) -> DataFrame:
    """Distinct and single-use templates, and the share of billed queries the head covers. One row.

    The head is a top-k; the totals and the head are one-row frames, unioned and summed.
    """
    counts = billed_templates(masked)
    zero = F.lit(0).cast("bigint")
    totals = counts.agg(
        F.coalesce(F.sum("n"), zero).alias("n_billed"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("n") == 1).alias("n_singleton"),
        zero.alias("head_covered"),
    )
    top = (
        counts.orderBy(F.desc("n"), "template")
        .limit(head)
        .agg(F.coalesce(F.sum("n"), zero).alias("head_covered"))
        .select(*[zero.alias(c) for c in ("n_billed", "n_distinct", "n_singleton")], "head_covered")
    )
    share = tx.ratio(F.col("head_covered"), F.col("n_billed"))
    return (
        totals.unionByName(top)
        .agg(*[F.sum(c).alias(c) for c in totals.columns])
        .withColumns(
            {
                "head_size": F.least(F.lit(head).cast("bigint"), F.col("n_distinct")),
                "head_coverage": share,
                "head_is_whole": F.col("n_distinct") <= head,
                "thin_head": F.coalesce(share < THIN_HEAD, F.lit(False)),
            }
        )
    )


def placeholder_counts(masked: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Billed queries with each placeholder; a field that never occurs still has its row."""
    billed = F.col("is_billed_query")
    counts = masked.agg(
        *[
            F.count_if(billed & F.contains("template", F.lit(f"<{f.upper()}>"))).alias(f)
            for f in fields
        ]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
    return counts.select(F.inline(pairs))


def collapse(masked: DataFrame) -> DataFrame:
    """Queries against distinct templates, for masked and for unmasked billed queries."""
    kind = F.when(F.col("n_placeholders") == 0, "unmasked").otherwise("masked")
    return (
        masked.filter("is_billed_query and template is not null")
        .groupBy(kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("n_queries"), F.countDistinct("template").alias("n_templates"))
        .withColumn("per_template", tx.ratio(F.col("n_queries"), F.col("n_templates")))
    )


def term_words(terms: DataFrame, min_chars: int = MIN_WORD) -> DataFrame:
    """The words of an entity's terms, as terms of their own."""
    return (
        terms.select("se10", "field", F.explode(F.split("value_norm", "[^0-9a-z]+")).alias("value_norm"))
        .filter(F.length("value_norm") >= min_chars)
        .distinct()
    )


def leftover_fields(masked: DataFrame, terms: DataFrame, row_key: Sequence[str], **options) -> DataFrame:
    """Billed queries of entities with words: kind, and the fields whose words are still there."""
    billed = masked.filter("is_billed_query and template is not null").select(
        *row_key, "template", "n_placeholders"
    )
    hit = attach_hits(billed, term_words(terms), F.col("template"), row_key, **options)
    return hit.filter("_has_terms").select(
        F.when(F.col("n_placeholders") > 0, "masked").otherwise("unmasked").alias("kind"),
        F.array_distinct(F.transform("_hits", lambda t: t["field"])).alias("fields"),
    )


def leftover_words(leftover: DataFrame) -> DataFrame:
    """Per kind: queries, and those that still hold a word of their entity's terms."""
    return (
        leftover.groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("fields") > 0).alias("n_hit"))
        .withColumn("hit_rate", tx.ratio(F.col("n_hit"), F.col("n")))
    )


def leftover_by_field(leftover: DataFrame) -> DataFrame:
    """Per kind and field: queries with such a word; a query counts once per field."""
    return (
        leftover.select("kind", F.explode("fields").alias("field"))
        .groupBy("kind", "field")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def head_templates(masked: DataFrame, n: int = HEAD_EXPORT, include_unmasked: bool = False) -> DataFrame:
    """The most frequent billed templates. Verbatim query text is held back unless asked for."""
    rows = masked.filter("template is not null and is_billed_query")
    if not include_unmasked:
        rows = rows.filter("n_placeholders > 0")
    return (
        rows.groupBy("template")
        .agg(
            F.count(F.lit(1)).alias("n_billed_calls"),
            F.countDistinct("se10").alias("n_merchants"),
            F.max("archetype").alias("archetype"),
        )
        .orderBy(F.desc("n_billed_calls"), "template")
        .limit(n)
    )


def withheld_count(masked: DataFrame, include_unmasked: bool = False) -> DataFrame:
    """How many distinct templates the head export holds back. One row."""
    held = masked.filter("template is not null and is_billed_query and n_placeholders = 0")
    return held.filter(F.lit(not include_unmasked)).agg(
        F.countDistinct("template").alias("n_withheld")
    )
