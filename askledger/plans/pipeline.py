"""From source files to the analysis tables, and from the tables to the reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.operators import anomaly as an
from askledger.operators import defects, entities, health, masking, records, runs, scorecard, usage, weblogs
from askledger.sources.tables import drop_table, read_tables, replace_stages, write_table
from askledger.streaming.resume import read_bronze

QUERY_KEY = ["src_file", "src_line", "se10", "run_key", "call_index", "q_ord"]
TABLES = (
    "runs", "search_calls", "query_instances", "merchants", "terms", "output_records", "questions",
    "answers", "citations", "votes", "anomalies",
)
# Stages of the anomalies that each step writes.
LOADED = (weblogs.STAGE, entities.STAGE, records.STAGE)
ANALYSED, REPARSED = "analyze", "reparse"


def shred_all(spark: SparkSession, out: str) -> None:
    """Parse each bronze line once and write the typed rows; later steps read only their columns."""
    write_table(weblogs.shred(read_bronze(spark, out, "weblog")), f"{out}/shredded/weblogs")
    write_table(entities.shred(read_bronze(spark, out, "input")), f"{out}/shredded/entities")
    write_table(records.shred_records(read_bronze(spark, out, "output")), f"{out}/shredded/records")
    # The runs of a record are read back as parsed parts: no line is parsed again.
    write_table(records.shred_runs(spark.read.parquet(f"{out}/shredded/records")), f"{out}/shredded/output_runs")


def tables_of(shredded: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The analysis tables from shredded weblogs, entities, records and output_runs."""
    logs, people, output, output_runs = (
        shredded[n] for n in ("weblogs", "entities", "records", "output_runs")
    )
    calls = weblogs.search_calls(logs)
    merchants = entities.merchants(people)
    found = an.union_all(
        [
            weblogs.anomalies(logs),
            entities.anomalies(people),
            records.anomalies(output, output_runs, merchants),
        ]
    )
    return {
        "runs": weblogs.runs(logs),
        "search_calls": calls,
        "query_instances": weblogs.query_instances(calls),
        "merchants": merchants,
        "terms": entities.pii_terms(merchants),
        "output_records": records.output_records(output),
        "questions": records.questions(output),
        "answers": records.answers(output_runs),
        "citations": records.citations(output_runs),
        "votes": records.votes(output),
        "anomalies": found,
    }


def build_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Shred bronze and write every analysis table under `out`; returns them as read back."""
    shred_all(spark, out)
    shredded = read_tables(
        spark, f"{out}/shredded", ["weblogs", "entities", "records", "output_runs"]
    )
    for name, df in tables_of(shredded).items():
        if name == "anomalies":
            replace_stages(df, f"{out}/{name}", LOADED)
        else:
            write_table(df, f"{out}/{name}")
    return dict(read_tables(spark, out, TABLES))


def mask(spark: SparkSession, out: str, groups: DataFrame) -> DataFrame:
    """Mask all queries, write them and this stage's anomalies; returns the masked queries.

    Can run again after the groupings changed or calls were read again: it replaces its own results only.
    """
    t = read_tables(spark, out, ["query_instances", "terms", "merchants"])
    write_table(
        masking.mask_queries(t["query_instances"], t["terms"], groups, QUERY_KEY), f"{out}/masked_queries"
    )
    masked = spark.read.parquet(f"{out}/masked_queries")
    replace_stages(masking.masking_anomalies(masked, groups, t["merchants"]), f"{out}/anomalies", [ANALYSED])
    return masked


def reparse(spark: SparkSession, out: str) -> DataFrame:
    """Read the stored calls again with the present rules; no source file is opened.

    The new calls go beside the old until they are complete, then replace them. Masked queries of the old calls go,
    and so do the anomalies found while masking: mask again.
    """
    calls, queries, found = weblogs.reparse_calls(spark.read.parquet(f"{out}/search_calls"))
    write_table(calls, f"{out}/search_calls_reparsed")
    again = spark.read.parquet(f"{out}/search_calls_reparsed")
    write_table(again, f"{out}/search_calls")
    write_table(weblogs.query_instances(again), f"{out}/query_instances")
    notes = weblogs.call_anomalies(again, REPARSED)
    replace_stages(notes, f"{out}/anomalies", [REPARSED, ANALYSED])
    drop_table(spark, f"{out}/masked_queries")
    return spark.read.parquet(f"{out}/search_calls")


def reports(
    tables: Mapping[str, DataFrame], masked: DataFrame, rates: DataFrame, source: str = "prose"
) -> dict[str, DataFrame]:
    """Every report as a lazy DataFrame; nothing runs until one is written."""
    t = tables
    used = usage.with_cost(
        usage.usage(t["runs"], t["search_calls"], t["query_instances"], ["tier"]), rates
    )
    by_run = usage.with_cost(
        usage.usage(t["runs"], t["search_calls"], t["query_instances"], ["run_id", "tier"]), rates
    )
    slices = runs.run_slices(by_run)
    card = scorecard.scorecard(t["answers"], t["citations"], source)
    third = runs.third_run(t["answers"], source)
    found = defects.run_defects(t["answers"], t["output_records"], t["runs"])
    leftover = masking.leftover_fields(masked, t["terms"], QUERY_KEY)
    return {
        "scorecard": card,
        "drop_candidates": scorecard.drop_candidates(card),
        "null_rate_by_source": scorecard.null_rate_by_source(t["answers"]),
        "parsed_from": scorecard.parsed_from_counts(t["answers"]),
        "subqueries_per_run": scorecard.subqueries_per_run(t["runs"], t["query_instances"], t["answers"]),
        "usage_by_tier": used,
        "total_cost": usage.total_cost(used),
        "missing_rates": usage.missing_rates(rates),
        "run_slices": slices,
        "cut_to_two_runs": runs.cut_to(slices),
        "unpriced_tiers": runs.unpriced_tiers(by_run),
        "run_count_distribution": runs.count_distribution(t["runs"]),
        "third_run": third,
        "third_run_totals": runs.third_run_totals(third, t["runs"]),
        "least_conclusive": runs.least_conclusive(third),
        "cache_by_run": usage.cache_by_run(t["runs"]),
        "shared_prefix": usage.shared_prefix(t["output_records"], "question_user_prompt"),
        "url_overlap": usage.url_overlap(t["citations"], t["search_calls"]),
        "archetypes": masking.archetype_rollup(masked),
        "masking_totals": masking.masking_totals(masked),
        "head_coverage": masking.head_coverage(masked),
        "placeholder_counts": masking.placeholder_counts(masked),
        "template_collapse": masking.collapse(masked),
        "leftover_words": masking.leftover_words(leftover),
        "leftover_by_field": masking.leftover_by_field(leftover),
        "defect_crosstab": defects.defect_crosstab(found),
        "defect_overlap": defects.defect_overlap(found),
        "defect_files": defects.defect_files(found),
        "defect_pointers": defects.defect_pointers(found),
        "anomaly_summary": an.anomaly_summary(t["anomalies"]),
        "health": health.health(
            {
                **{k: t[k] for k in ("merchants", "runs", "terms", "questions", "answers", "citations", "votes", "anomalies")},
                "records": t["output_records"], "calls": t["search_calls"], "queries": masked,
            }
        ),
    }


def ingest_metrics(
    bronze: DataFrame, logs: DataFrame, people: DataFrame, output: DataFrame, output_runs: DataFrame
) -> DataFrame:
    """Load summary as rows (kind, name, value), each shredded table read once per level.

    Numbers that another report has already (duplicates, drift, conflicts) are in the anomaly summary.
    """

    def rows(df: DataFrame, kind: str) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value")) for c in df.columns]
        )
        return df.select(F.lit(kind).alias("kind"), F.inline(cells))

    def count(cond) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    def total(col) -> Column:
        return F.coalesce(F.sum(col), F.lit(0))

    lines = bronze.groupBy("kind").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("is_damaged").alias("damaged_lines")
    )
    line_rows = lines.select("kind", F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("lines", "damaged_lines")
    ])))
    first_of_entity = F.col("is_entity") & (F.coalesce("run_pos", F.lit(0)) == 0)
    log_rows = rows(
        logs.agg(
            count(first_of_entity).alias("entities"),
            count(F.col("is_run")).alias("runs"),
            total(F.size("calls")).alias("calls"),
        ),
        "weblog",
    )
    calls = weblogs.search_calls(logs)
    call_rows = (
        calls.select(F.explode(F.array(
            F.concat(F.lit("action_"), "action_type"), F.concat(F.lit("conf_"), "parse_conf")
        )).alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.lit("weblog").alias("kind"), "name", "value")
    )
    people_rows = rows(entities.without_terms(entities.merchants(people)), "input")
    record_rows = rows(
        output.filter("is_record").agg(
            F.count(F.lit(1)).alias("records"),
            count(F.size("questions") == 0).alias("no_questions"),
            count(F.col("n_answer_runs") == 0).alias("no_answers"),
            count(F.size("votes") == 0).alias("no_votes"),
            count(F.col("n_runs") != F.col("n_answer_runs")).alias("n_runs_mismatch"),
            count(F.col("empty_voted_final")).alias("empty_voted_final"),
            total(F.size("votes")).alias("votes"),
            total(F.size(F.filter("votes", lambda v: v["differs"]))).alias("votes_differ"),
        ),
        "output",
    )
    run_rows = rows(
        output_runs.agg(
            F.count(F.lit(1)).alias("runs"),
            total(F.size("blocks")).alias("answer_blocks"),
            total(F.size(F.filter("links", lambda c: ~c["empty_placeholder"]))).alias("prose_citations"),
            total(F.size(F.filter("links", lambda c: c["empty_placeholder"]))).alias("empty_placeholders"),
            total(F.size("dict_links")).alias("dict_citations"),
            total("n_stray_citations").alias("citations_outside_blocks"),
            total("n_split").alias("citation_mismatches"),
            total("n_disagreed").alias("answer_disagreements"),
            total(
                F.size(F.filter("blocks", lambda x: (x["shape"] == "bare") & (x["evidence"] == "present")))
            ).alias("bare_with_evidence"),
        ),
        "output",
    )
    block_rows = (
        output_runs.select(F.explode("blocks").alias("x"))
        .select(F.explode(F.array(
            F.concat(F.lit("block_"), "x.shape"), F.concat(F.lit("evidence_"), "x.evidence")
        )).alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.lit("output").alias("kind"), "name", "value")
    )
    source_rows = (
        output_runs.select(F.explode("answers.parsed_from").alias("p"))
        .groupBy(F.concat(F.lit("answers_from_"), "p").alias("name"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.lit("output").alias("kind"), "name", "value")
    )
    return an.union_all(
        [line_rows, log_rows, call_rows, people_rows, record_rows, run_rows, block_rows, source_rows]
    )
