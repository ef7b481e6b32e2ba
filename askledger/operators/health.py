"""Health of a loaded corpus, as rows (section, metric, key, value).

All breakdowns of a table come from one pass, and so do all its totals; a table's sections are separate passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.functions import variants as va
from askledger.operators import masking, usage
from askledger.operators.anomaly import union_all
from askledger.operators.defects import dict_runs
from askledger.operators.entities import COLUMN_KEYS, TERM_KEYS
from askledger.operators.scorecard import QUESTIONS_ASKED, answer_facts

# Keys that may hold an outcome, and how many distinct values such a key may have
# for them to be shown (a disclosure gate: the values of other keys may be free text).
LABEL_KEYS = ("se_not_good_seller_ind", "se_not_good_reason", "HRSE_tagged_merchant_ind")
MAX_SHOWN_VALUES = 8


def as_metrics(one_row: DataFrame, section: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """A one-row frame turned into metric rows; booleans become 1 and 0."""
    names = metrics or one_row.columns
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
    )
    return one_row.select(F.lit(section).alias("section"), F.inline(rows))


def keyed(df: DataFrame, section: str, metric: str, key: str, value: str) -> DataFrame:
    """Rows of a keyed count as metric rows."""
    return df.select(
        F.lit(section).alias("section"),
        F.lit(metric).alias("metric"),
        F.col(key).cast("string").alias("key"),
        F.col(value).cast("double").alias("value"),
    )


def keyed_cells(df: DataFrame, section: str, key: str, metrics: Sequence[str]) -> DataFrame:
    """Several values of each keyed row as metric rows, in one pass."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(key).cast("string").alias("key"), F.col(n).cast("double").alias("value"))
            for n in metrics
        ]
    )
    return df.select(F.lit(section).alias("section"), F.inline(cells))


def breakdowns(df: DataFrame, section: str, dims: Mapping[str, Column]) -> DataFrame:
    """Row counts by each of several dimensions, in one pass over `df`."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("metric"), c.cast("string").alias("key")) for n, c in dims.items()]
        )
    )
    return (
        df.select(pairs.alias("p"))
        .groupBy("p.metric", "p.key")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit(section).alias("section"), "metric", "key", "value")
    )


def corpus_counts(
    merchants: DataFrame, runs: DataFrame, records: DataFrame, terms: DataFrame
) -> DataFrame:
    """Entities per source, runs, records and terms. One row."""
    names = ("merchants_input", "merchants_logs", "merchants_outputs", "n_runs", "n_records", "n_terms")
    zero = F.lit(0).cast("bigint")

    def side(df: DataFrame, **counts: Column) -> DataFrame:
        return df.agg(*[c.alias(n) for n, c in counts.items()]).select(
            *[F.col(n) if n in counts else zero.alias(n) for n in names]
        )

    rows = F.count(F.lit(1))
    entities = F.countDistinct("se10")
    sides = [
        side(merchants, merchants_input=rows),
        side(runs, merchants_logs=entities, n_runs=rows),
        side(records, merchants_outputs=entities, n_records=rows),
        side(terms, n_terms=rows),
    ]
    return union_all(sides).agg(*[F.sum(n).alias(n) for n in names])


def reconcile_runs(runs: DataFrame, answers: DataFrame, records: DataFrame) -> DataFrame:
    """Which runs exist on the log side, the output side, or both. One row.

    Both sides are cut to distinct runs, then grouped together on (entity, run index).
    Run keys that could not be read have no index: they are counted, not compared.
    """
    out = (
        answers.filter("run_id is not null")
        .select("output_id", "run_id")
        .distinct()
        .join(records.select("output_id", "se10"), "output_id")
    )
    sides = (
        runs.filter("run_id is not null")
        .select("se10", "run_id", F.lit(1).alias("l"), F.lit(0).alias("o"))
        .unionByName(out.select("se10", "run_id", F.lit(0).alias("l"), F.lit(1).alias("o")))
        .groupBy("se10", "run_id")
        .agg(F.max("l").alias("l"), F.max("o").alias("o"))
        .select("l", "o", F.lit(0).alias("u"))
        .unionByName(
            runs.filter("run_id is null").select(F.lit(0).alias("l"), F.lit(0).alias("o"), F.lit(1).alias("u"))
        )
    )
    log, outp = F.col("l") == 1, F.col("o") == 1
    return sides.agg(
        F.count_if(log).alias("n_log"),
        F.count_if(outp).alias("n_out"),
        F.count_if(outp & ~log).alias("output_only"),
        F.count_if(log & ~outp).alias("log_only"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("n_unparsed"),
    )


def terms_by_field(terms: DataFrame) -> DataFrame:
    return terms.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def column_fill(merchants: DataFrame, columns: Sequence[str] = tuple(COLUMN_KEYS)) -> DataFrame:
    """How many rows fill each column, and whether none does."""
    counts = merchants.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c) != "").alias(c) for c in columns]
    )
    table = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.col(c).alias("n_filled"), (F.col(c) == 0).alias("is_empty"),
                F.col("_rows").alias("n_rows"),
            )
            for c in columns
        ]
    )
    return counts.select(F.inline(table))


def schema_keys(
    merchants: DataFrame,
    wanted: Sequence[str] = tuple(sorted({k for keys in TERM_KEYS.values() for k in keys})),
) -> DataFrame:
    """Keys of all parseable records, and which personal-data keys they have. Names only."""
    seen = (
        merchants.select(F.explode(F.json_object_keys("raw_json")).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_records"))
        .select("key", "n_records", F.lit(False).alias("is_wanted"))
    )
    expected = merchants.sparkSession.createDataFrame([(k,) for k in wanted], "key string").select(
        "key", F.lit(0).cast("bigint").alias("n_records"), F.lit(True).alias("is_wanted")
    )
    return (
        seen.unionByName(expected)
        .groupBy("key")
        .agg(F.sum("n_records").alias("n_records"), F.bool_or("is_wanted").alias("is_wanted"))
        .withColumn("is_present", F.col("n_records") > 0)
    )


def _label_rows(merchants: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("v")
    parsed = merchants.select(F.try_parse_json("raw_json").alias("v")).filter(
        va.as_object(v).isNotNull()
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("key"),
                    va.field(v, k).isNotNull().alias("has_key"),
                    F.nullif(va.text_or_dump(va.field(v, k)), F.lit("")).alias("value"),
                )
                for k in keys
            ]
        )
    )
    return (
        parsed.select(cells.alias("c"))
        .select("c.*")
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("has_key").alias("n_has"))
    )


def label_candidates(merchants: DataFrame, keys: Sequence[str] = LABEL_KEYS) -> DataFrame:
    """Keys that may hold an outcome: present, filled and distinct values over all records."""
    filled = F.col("value").isNotNull()
    return (
        _label_rows(merchants, keys)
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_records"),
            (F.sum("n_has") > 0).alias("is_present"),
            F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("n_filled"),
            F.count("value").alias("n_distinct"),
        )
        .withColumn("fill_share", tx.ratio(F.col("n_filled"), F.col("n_records")))
    )


def label_values(
    merchants: DataFrame, keys: Sequence[str] = LABEL_KEYS, shown: int = MAX_SHOWN_VALUES
) -> DataFrame:
    """Values of those keys that have few of them; free text is never shown.

    A key with more values than that has one row instead, without a value, that says how many are withheld.
    """
    rows = _label_rows(merchants, keys).filter("value is not null")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"))
    coded, coarse = sizes.filter(F.col("d") <= shown), sizes.filter(F.col("d") > shown)
    none = F.lit(0).cast("bigint")
    told = rows.join(coded, "key", "left_semi").select("key", "value", "n", none.alias("n_withheld"))
    return told.unionByName(
        coarse.select("key", F.lit(None).cast("string").alias("value"), "n", F.col("d").alias("n_withheld"))
    )


def unreadable_runs(answers: DataFrame) -> DataFrame:
    """Runs whose answers all, or partly, came from the dict. One row."""
    return dict_runs(answers).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("n_dict") == F.col("n_answers")).alias("n_all_dict"),
        F.count_if((F.col("n_dict") > 0) & (F.col("n_dict") < F.col("n_answers"))).alias("n_part_dict"),
    )


def agreement_tallies(answers: DataFrame) -> DataFrame:
    """Agree, differ and not comparable, against each of the two other parses."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("answer_dict").alias("other"), F.col("agree_with_dict").alias("agrees")),
            F.struct(F.lit("citation_evidence").alias("other"), F.col("agree_with_ce").alias("agrees")),
        )
    )
    return (
        answers.select(sides.alias("s"))
        .select("s.*")
        .groupBy("other")
        .agg(
            F.count_if(F.col("agrees")).alias("n_agree"),
            F.count_if(~F.col("agrees")).alias("n_differ"),
            F.count_if(F.col("agrees").isNull()).alias("n_not_comparable"),
        )
        .withColumn("differ_rate", tx.ratio(F.col("n_differ"), F.col("n_agree") + F.col("n_differ")))
    )


def answer_sources(answers: DataFrame, asked: int = QUESTIONS_ASKED) -> DataFrame:
    """How far the second parse reaches, per answer and per run. One row.

    Answers are first summed per run; both levels then come from one aggregate.
    """
    shown = "present"
    from_dict = F.col("parsed_from") == "answer_dict"
    per_run = (
        answer_facts(answers)
        .groupBy("output_id", "run_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("ce_answer").alias("c"),
            F.count_if((F.col("evidence_shape") != shown) & (F.col("ce_evidence_shape") == shown)).alias("rep"),
            F.count_if(from_dict).alias("d"),
            F.count_if(from_dict & F.col("agree_with_ce")).alias("da"),
            F.count_if(from_dict & ~F.col("agree_with_ce")).alias("dd"),
        )
    )
    zero = F.lit(0)
    return per_run.agg(
        F.coalesce(F.sum("n"), zero).alias("n_answers"),
        F.coalesce(F.sum("c"), zero).alias("n_ce_answers"),
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("c") == asked).alias("n_runs_full"),
        F.count_if(F.col("c") == 0).alias("n_runs_none"),
        F.coalesce(F.sum("rep"), zero).alias("n_evidence_repaired"),
        F.coalesce(F.sum("d"), zero).alias("n_from_dict"),
        F.coalesce(F.sum("da"), zero).alias("n_dict_agree"),
        F.coalesce(F.sum("dd"), zero).alias("n_dict_differ"),
    ).withColumns(
        {
            "ce_share": tx.ratio(F.col("n_ce_answers"), F.col("n_answers")),
            "ce_per_run": tx.ratio(F.col("n_ce_answers"), F.col("n_runs")),
        }
    )


def evidence_links(answers: DataFrame) -> DataFrame:
    """Answers whose evidence has a markdown link, and how it is wrapped. One row."""
    text = F.col("evidence_text")
    return answers.filter(text.like("%](%")).agg(
        F.count(F.lit(1)).alias("n_any_link"), F.count_if(text.like("%([%](%")).alias("n_wrapped")
    ).withColumn("n_bare", F.col("n_any_link") - F.col("n_wrapped"))


def answer_totals(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count(F.lit(1)).alias("n_answers"), F.count_if("is_null").alias("n_null"))


def query_totals(queries: DataFrame) -> DataFrame:
    billed = F.col("is_billed_query")
    return queries.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(billed).alias("n_billed"),
        F.count_if(~billed).alias("n_sub_queries"),
    )


def vote_totals(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count(F.lit(1)).alias("n_votes"), F.count_if("differs").alias("n_differ"))


def call_breakdowns(calls: DataFrame) -> DataFrame:
    return breakdowns(calls, "calls", {"action_type": F.col("action_type"), "status": F.col("status")})


def answer_breakdowns(answers: DataFrame) -> DataFrame:
    facts = answer_facts(answers)
    return breakdowns(
        facts,
        "answers",
        {c: F.col(c) for c in ("parsed_from", "evidence_shape", "ce_evidence_shape")},
    )


def citation_breakdowns(citations: DataFrame) -> DataFrame:
    return breakdowns(
        citations,
        "citations",
        {
            "source": F.col("source"),
            "empty_placeholder": F.col("empty_placeholder"),
        },
    )


def question_count(questions: DataFrame, asked: int = QUESTIONS_ASKED) -> DataFrame:
    return questions.agg(F.count(F.lit(1)).alias("n_questions")).withColumn(
        "is_unexpected", F.col("n_questions") != asked
    )


def templating(masked: DataFrame) -> list[DataFrame]:
    """Masking metrics, with a flag that tells "not run" from "nothing matched"."""
    totals = masking.masking_totals(masked).withColumn("has_run", F.col("n_templated") > 0)
    return [
        as_metrics(totals, "templating"),
        as_metrics(masking.head_coverage(masked).drop("n_billed"), "templating"),
        keyed(masking.placeholder_counts(masked), "templating", "placeholder", "field", "n"),
    ]


def health(tables: Mapping[str, DataFrame], asked: int = QUESTIONS_ASKED) -> DataFrame:
    """Every metric of the tables given; missing tables leave their section out. `asked`: questions of a full run.

    Known tables: merchants, terms, runs, calls, queries (masked), records, questions, answers,
    citations, votes, anomalies.
    """
    t = tables
    out: list[DataFrame] = []
    if {"merchants", "runs", "records", "terms"} <= t.keys():
        out.append(as_metrics(corpus_counts(t["merchants"], t["runs"], t["records"], t["terms"]), "corpus"))
    if {"runs", "answers", "records"} <= t.keys():
        out.append(as_metrics(reconcile_runs(t["runs"], t["answers"], t["records"]), "reconciliation"))
    if "terms" in t:
        out.append(keyed(terms_by_field(t["terms"]), "input", "terms_by_field", "field", "n"))
    if "merchants" in t and "raw_json" in t["merchants"].columns:
        m = t["merchants"]
        keys = schema_keys(m)
        labels = label_candidates(m)
        out += [
            keyed(column_fill(m), "input", "column_filled", "column_name", "n_filled"),
            keyed(keys.filter("is_wanted"), "input", "pii_key_records", "key", "n_records"),
            as_metrics(keys.agg(F.count_if("is_present").alias("n_keys_seen")), "input"),
            keyed(
                keys.filter("is_present"), "input", "key_seen", "key", "n_records"
            ),
            keyed_cells(labels, "labels", "key", ("is_present", "n_filled", "n_distinct", "fill_share")),
            keyed(
                label_values(m).withColumn("key", F.concat_ws("=", "key", "value")), "labels", "value", "key", "n"
            ),
        ]
    if "questions" in t:
        out.append(as_metrics(question_count(t["questions"], asked), "questions"))
    if "calls" in t:
        out.append(call_breakdowns(t["calls"]))
    if "queries" in t:
        out.append(as_metrics(query_totals(t["queries"]), "queries"))
        if "template" in t["queries"].columns:
            out += templating(t["queries"])
    if "runs" in t:
        out += [
            keyed(usage.tier_mix(t["runs"]), "tokens", "service_tier", "tier", "n"),
            as_metrics(usage.token_summary(t["runs"]), "tokens"),
        ]
    if "answers" in t:
        a = t["answers"]
        tallies = agreement_tallies(a)
        out += [
            as_metrics(answer_totals(a), "answers"),
            answer_breakdowns(a),
            as_metrics(unreadable_runs(a), "unreadable"),
            keyed_cells(tallies, "agreement", "other", ("n_agree", "n_differ", "n_not_comparable", "differ_rate")),
            as_metrics(answer_sources(a, asked), "answer_sources"),
            as_metrics(evidence_links(a), "evidence_links"),
        ]
    if "citations" in t:
        out.append(citation_breakdowns(t["citations"]))
    if "votes" in t:
        out.append(as_metrics(vote_totals(t["votes"]), "votes"))
    if "anomalies" in t:
        out.append(breakdowns(t["anomalies"], "anomalies", {"code": F.col("code")}))
    return union_all(out)
