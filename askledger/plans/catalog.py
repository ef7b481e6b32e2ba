"""Every operator as a named query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.operators import anomaly as an
from askledger.operators import attribution as at
from askledger.operators import defects as df_
from askledger.operators import entities as en
from askledger.operators import health as hl
from askledger.operators import insight as ins
from askledger.operators import masking as mk
from askledger.operators import merging as mg
from askledger.operators import records as rc
from askledger.operators import runs as rn
from askledger.operators import scorecard as sc
from askledger.operators import usage as us
from askledger.operators import weblogs as wl
from askledger.plans import binding as b
from askledger.plans import json_binding as jb
from askledger.plans import pipeline as pl
from askledger.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Sums of money depend on the order of addition; keep the digits that do not."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- scorecard -----------------------------------------------------------------------------


@query
def scorecard(s, d):
    return sc.scorecard(b.answers(s, d), b.citations(s, d))


@query
def scorecard_ce(s, d):
    return sc.scorecard(b.answers(s, d), b.citations(s, d), "ce")


@query
def drop_candidates(s, d):
    return sc.drop_candidates(scorecard(s, d))


@query
def null_rate_by_source(s, d):
    return sc.null_rate_by_source(b.answers(s, d))


@query
def parsed_from_counts(s, d):
    return sc.parsed_from_counts(b.answers(s, d))


@query
def blind_answers(s, d):
    return sc.blind_answers(sc.question_counts(b.answers(s, d)))


@query
def subqueries_per_run(s, d):
    return sc.subqueries_per_run(b.runs(s, d), b.call_queries(s, d), b.answers(s, d), asked=3)


# --- usage and cost ------------------------------------------------------------------------


def _usage(s, d, *by):
    used = us.usage(b.runs(s, d), b.calls(s, d), b.call_queries(s, d), by)
    return us.with_cost(used, b.rates(s))


@query
def usage_by_tier(s, d):
    return _usage(s, d, "tier")


@query
def usage_by_run(s, d):
    return _usage(s, d, "run_id", "tier")


@query
def total_cost(s, d):
    return rounded(us.total_cost(usage_by_tier(s, d)), 6, "total")


@query
def run_slices(s, d):
    return rounded(rn.run_slices(usage_by_run(s, d)), 6, "cost", "fee")


@query
def unpriced_tiers(s, d):
    return rn.unpriced_tiers(usage_by_run(s, d))


@query
def cut_to_two_runs(s, d):
    cut = rn.cut_to(rn.run_slices(usage_by_run(s, d)))
    return rounded(rounded(cut, 6, "cut_cost", "cut_fee", "total_cost"), 9, "cut_cost_share")


@query
def run_count_distribution(s, d):
    return rn.count_distribution(b.runs(s, d))


@query
def cache_by_run(s, d):
    return us.cache_by_run(b.runs(s, d))


@query
def shared_prefix(s, d):
    return us.shared_prefix(b.records(s, d), "question_user_prompt")


@query
def shared_prefix_by_source(s, d):
    return us.shared_prefix(b.table(s, d, "documents"), "text", ["source"])


@query
def url_overlap(s, d):
    return us.url_overlap(b.citations(s, d), b.calls(s, d))


@query
def token_summary(s, d):
    return us.token_summary(b.runs(s, d))


@query
def tier_mix(s, d):
    return us.tier_mix(b.runs(s, d))


# --- third run -----------------------------------------------------------------------------


@query
def third_run(s, d):
    return rn.third_run(b.answers(s, d))


@query
def third_run_ce(s, d):
    return rn.third_run(b.answers(s, d), "ce")


@query
def least_conclusive(s, d):
    return rn.least_conclusive(third_run(s, d))


@query
def third_run_totals(s, d):
    return rn.third_run_totals(third_run(s, d), b.runs(s, d))


# --- masking -------------------------------------------------------------------------------


def _mask(s, d):
    return mk.mask_queries(b.entity_queries(s, d), b.terms(s, d), b.groups(s, d), b.QUERY_KEY)


def _masked(s, d, *columns):
    # Masked once and written: a filter on the template would otherwise mask every query again.
    return staged(_mask(s, d).select(*columns or "*"))


@query
def mask_queries(s, d):
    return _mask(s, d).select(*b.QUERY_KEY, "template", "n_placeholders", "archetype", "has_terms")


@query
def unmatched_groups(s, d):
    return mk.unmatched_groups(_masked(s, d), b.groups(s, d))


@query
def unmaskable(s, d):
    return mk.unmaskable(_masked(s, d), b.entities(s, d))


@query
def masking_anomalies(s, d):
    found = mk.masking_anomalies(_masked(s, d), b.groups(s, d), b.entities(s, d))
    return found.select("stage", "code", "se10")


@query
def mask_counters(s, d):
    return mk.mask_counters(_masked(s, d), b.groups(s, d))


@query
def archetype_rollup(s, d):
    return mk.archetype_rollup(_masked(s, d))


@query
def masking_totals(s, d):
    return mk.masking_totals(_masked(s, d))


@query
def head_coverage(s, d):
    return mk.head_coverage(_masked(s, d))


@query
def placeholder_counts(s, d):
    return mk.placeholder_counts(_masked(s, d))


@query
def template_collapse(s, d):
    return mk.collapse(_masked(s, d))


@query
def leftover_words(s, d):
    return mk.leftover_words(mk.leftover_fields(_masked(s, d), b.terms(s, d), b.QUERY_KEY))


@query
def leftover_by_field(s, d):
    return mk.leftover_by_field(mk.leftover_fields(_masked(s, d), b.terms(s, d), b.QUERY_KEY))


@query
def head_templates(s, d):
    return mk.head_templates(_masked(s, d))


@query
def head_templates_all(s, d):
    return mk.head_templates(_masked(s, d), include_unmasked=True)


@query
def withheld_templates(s, d):
    return mk.withheld_count(_masked(s, d))


@query
def merged_templates(s, d):
    return mg.merged_templates(mk.billed_templates(_masked(s, d, "template", "is_billed_query")))


@query
def merged_counts(s, d):
    return mg.merged_counts(merged_templates(s, d))


# --- health and defects --------------------------------------------------------------------


@query
def run_defects(s, d):
    return df_.run_defects(b.answers(s, d), b.records(s, d), b.runs(s, d))


@query
def defect_crosstab(s, d):
    return df_.defect_crosstab(run_defects(s, d))


@query
def defect_overlap(s, d):
    return df_.defect_overlap(run_defects(s, d))


@query
def defect_files(s, d):
    return df_.defect_files(run_defects(s, d))


@query
def defect_pointers(s, d):
    return df_.defect_pointers(run_defects(s, d))


@query
def defect_export_output_only(s, d):
    return df_.defect_exports(run_defects(s, d))["output_only"]


@query
def corpus_counts(s, d):
    return hl.corpus_counts(b.entities(s, d), b.runs(s, d), b.records(s, d), b.terms(s, d))


@query
def reconcile_runs(s, d):
    return hl.reconcile_runs(b.runs(s, d), b.answers(s, d), b.records(s, d))


@query
def terms_by_field(s, d):
    return hl.terms_by_field(b.terms(s, d))


@query
def unreadable_runs(s, d):
    return hl.unreadable_runs(b.answers(s, d))


@query
def agreement_tallies(s, d):
    return hl.agreement_tallies(b.answers(s, d))


@query
def answer_sources(s, d):
    return hl.answer_sources(b.answers(s, d), asked=8)


@query
def evidence_links(s, d):
    return hl.evidence_links(b.answers(s, d))


@query
def answer_totals(s, d):
    return hl.answer_totals(b.answers(s, d))


@query
def query_totals(s, d):
    return hl.query_totals(b.entity_queries(s, d))


@query
def call_breakdowns(s, d):
    return hl.call_breakdowns(b.calls(s, d))


@query
def answer_breakdowns(s, d):
    return hl.answer_breakdowns(b.answers(s, d))


@query
def citation_breakdowns(s, d):
    return hl.citation_breakdowns(b.citations(s, d))


@query
def citation_domains(s, d):
    return b.citations(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


# --- parsing: web-search logs --------------------------------------------------------------


# Lines are parsed once and written; every fact is then a read of some columns.


def _logs(s, d):
    return staged(wl.shred(jb.weblog_lines(s, d)))


@query
def weblog_runs(s, d):
    return wl.runs(_logs(s, d)).drop("src_rank")


@query
def weblog_duplicate_runs(s, d):
    return wl.duplicate_runs(_logs(s, d)).select(
        "se10", "run_key", "src_file", "src_line", "n_copies",
        F.col("first.src_file").alias("first_file"), F.col("first.src_line").alias("first_line"),
    )


@query
def weblog_calls(s, d):
    return wl.search_calls(_logs(s, d)).select(
        "src_file", "src_line", "se10", "run_key", "run_id", "call_index", "call_id", "action_type", "status",
        "query_raw", F.array_join("queries", "|").alias("queries"), "url", "details", "parse_conf",
        F.size("notes").alias("n_notes"),
    )


@query
def weblog_queries(s, d):
    return wl.query_instances(wl.search_calls(_logs(s, d))).drop("src_rank")


@query
def weblog_anomalies(s, d):
    return wl.anomalies(_logs(s, d)).select("code", "se10", "src_file", "src_line")


@query
def anomaly_summary(s, d):
    return an.anomaly_summary(wl.anomalies(_logs(s, d)))


@query
def anomaly_payload(s, d):
    capped = an.cap_payload(wl.anomalies(_logs(s, d)))
    return capped.groupBy("code", "src_file").agg(
        F.count(F.lit(1)).alias("n"), F.count("raw_excerpt").alias("n_excerpts")
    )


@query
def anomaly_payload_of_three(s, d):
    """The payload cap where it bites: texts on the first three rows of a code in a file."""
    return an.cap_payload(wl.anomalies(_logs(s, d)), rows=3).groupBy("code", "src_file").agg(
        F.count(F.lit(1)).alias("n"), F.count("raw_excerpt").alias("n_excerpts")
    )


@query
def anomaly_samples(s, d):
    return an.anomaly_samples(wl.anomalies(_logs(s, d)), "QUERY_REQUOTED", 10).select(
        "code", "se10", "src_file", "src_line", "rn"
    )


@query
def reparsed_calls(s, d):
    again, _, _ = wl.reparse_calls(wl.search_calls(_logs(s, d)).drop("notes"))
    return again.groupBy("action_type", "parse_conf").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("queries")), F.lit(0)).alias("n_queries")
    )


@query
def reparsed_anomalies(s, d):
    _, _, found = wl.reparse_calls(wl.search_calls(_logs(s, d)).drop("notes"))
    return found.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"))


# --- parsing: entities ---------------------------------------------------------------------


def _entities(s, d):
    return staged(en.shred(jb.input_lines(s, d)))


@query
def input_merchants(s, d):
    return en.merchants(_entities(s, d)).select(
        "se10", "city", "email", "phone", "website", "state", "industry_tagged", "street", "src_file", "src_line"
    )


@query
def input_terms(s, d):
    return en.pii_terms(en.merchants(_entities(s, d)))


@query
def input_term_counts(s, d):
    return en.without_terms(en.merchants(_entities(s, d)))


@query
def input_anomalies(s, d):
    return en.anomalies(_entities(s, d)).select("code", "se10", "src_file", "src_line")


@query
def column_fill(s, d):
    return hl.column_fill(en.merchants(_entities(s, d)))


@query
def schema_keys(s, d):
    return hl.schema_keys(en.merchants(_entities(s, d)))


@query
def label_candidates(s, d):
    return hl.label_candidates(en.merchants(_entities(s, d)))


@query
def label_values(s, d):
    return hl.label_values(en.merchants(_entities(s, d)))


@query
def customer_terms(s, d):
    fields = {"name": ["c_name"], "city": ["c_mktsegment"], "zip": ["c_nationkey"]}
    return en.explode_terms(
        b.table(s, d, "customer").withColumn("se10", F.col("c_custkey").cast("string")), fields
    )


# --- parsing: output records ---------------------------------------------------------------


def _records(s, d):
    return staged(rc.shred_records(jb.output_lines(s, d)))


def _output_runs(s, d):
    return _runs_of(_records(s, d))


def _runs_of(shredded):
    return staged(rc.shred_runs(shredded))


@query
def output_records(s, d):
    return rc.output_records(_records(s, d)).select(
        "output_id", "se10", "n_runs", "n_answer_runs", "question_user_prompt", "dup_flag", "empty_voted_final"
    )


@query
def output_questions(s, d):
    return rc.questions(_records(s, d))


@query
def question_drift(s, d):
    return rc.question_drift(_records(s, d)).select(
        "output_id", F.array_join("missing", ",").alias("missing"), F.array_join("added", ",").alias("added"), "text_varies"
    )


@query
def output_answers(s, d):
    return rc.answers(_output_runs(s, d)).drop("src_rank", "src_file", "src_line")


@query
def output_citations(s, d):
    return rc.citations(_output_runs(s, d)).drop("src_rank", "src_file", "src_line")


@query
def output_votes(s, d):
    return rc.votes(_records(s, d)).drop("src_rank", "src_file", "src_line")


@query
def short_runs(s, d):
    shredded = _records(s, d)
    return rc.short_runs(_runs_of(shredded), shredded).select(
        "src_file", "src_line", "run_key", "n_seen", "n_canonical", F.array_join("missing", ",").alias("missing")
    )


@query
def duplicate_records(s, d):
    return rc.duplicate_records(_records(s, d)).select("se10", "src_file", "src_line", "n_copies", "identical")


@query
def field_conflicts(s, d):
    output = rc.output_records(_records(s, d))
    return rc.field_conflicts(output, en.merchants(_entities(s, d))).select(
        "output_id", "has_input", F.array_join("clashes", "; ").alias("clashes")
    )


@query
def output_anomalies(s, d):
    shredded = _records(s, d)
    found = rc.anomalies(shredded, _runs_of(shredded), en.merchants(_entities(s, d)))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src_file", "src_line").alias("n_lines"))


@query
def fullest_records(s, d):
    kept = ins.fullest_records(rc.output_records(_records(s, d)), ["src_rank", "src_file", "src_line"])
    return kept.select("se10", "output_id", "n_answer_runs")


@query
def answer_spread(s, d):
    return ins.answer_spread(b.answers(s, d))


@query
def citation_queries(s, d):
    asked = b.entity_queries(s, d).withColumn("run_id", F.col("call_index") % 3)
    return at.best_queries(b.entity_citations(s, d).withColumn("domain", tx.hostname(F.col("url"))), asked)


@query
def calls_by_position(s, d):
    return ins.calls_by_position(b.calls(s, d), b.citations(s, d))


@query
def calls_per_entity(s, d):
    return ins.calls_per_entity(b.calls(s, d))


@query
def usage_capped_at_two(s, d):
    used = ins.capped_usage(b.runs(s, d), b.calls(s, d), b.call_queries(s, d), ["tier"], 2)
    return us.with_cost(used, b.rates(s))


@query
def label_value(s, d):
    labels = b.table(s, d, "part").selectExpr("cast(p_partkey as string) as se10", "p_size % 2 as label")
    return ins.label_value(b.answers(s, d), labels)


@query
def ingest_metrics(s, d):
    bronze = an.union_all([jb.weblog_lines(s, d), jb.input_lines(s, d), jb.output_lines(s, d)])
    shredded = _records(s, d)
    return pl.ingest_metrics(bronze, _logs(s, d), _entities(s, d), shredded, _runs_of(shredded))


@query
def health(s, d):
    """All health metrics of the bound tables at once."""
    output = _records(s, d)
    return hl.health(
        {
            "questions": rc.questions(output), "votes": rc.votes(output), "anomalies": wl.anomalies(_logs(s, d)),
            "merchants": b.entities(s, d), "terms": b.terms(s, d), "runs": b.runs(s, d), "calls": b.calls(s, d),
            "queries": _masked(s, d), "records": b.records(s, d), "answers": b.answers(s, d),
            "citations": b.citations(s, d),
        },
        asked=8,
    )
