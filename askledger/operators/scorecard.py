"""Per-question scorecard over answers and citations.

An answer row carries up to three parses of the same prose. Every rate is NULL, not zero,
when nothing could be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import text as tx

# Which parse leads, by answer source.
ANSWER_SOURCES = {
    "prose": ("answer_text", "ce_answer"),
    "ce": ("ce_answer", "answer_text"),
}
# Fixed value: the number of questions each run is asked.
QUESTIONS_ASKED = 48


def chosen_answer(source: str) -> Column:
    """The answer under `source`: the leading parse, else the other one."""
    if source not in ANSWER_SOURCES:
        raise ValueError(f"unknown answer source {source!r}; use one of {sorted(ANSWER_SOURCES)}")
    return F.coalesce(*[F.col(c) for c in ANSWER_SOURCES[source]])


def answer_facts(answers: DataFrame) -> DataFrame:
    """Answers with the evidence shape of both parses."""
    return answers.withColumns(
        {
            "evidence_shape": tx.evidence_shape(F.col("evidence_text")),
            "ce_evidence_shape": tx.evidence_shape(F.col("ce_evidence")),
        }
    )


def question_counts(answers: DataFrame, source: str = "prose") -> DataFrame:
    """Counts per question that need no other table. One shuffle of a row per question."""
    ans = F.trim(chosen_answer(source))
    facts = answer_facts(answers.filter(F.col("qnum").isNotNull())).select(
        "qnum",
        tx.is_scale(ans).alias("scale"),
        tx.is_three(ans).alias("three"),
        tx.is_null_word(ans).alias("nul"),
        ((F.col("evidence_shape") == "present") | (F.col("ce_evidence_shape") == "present")).alias(
            "has_ev"
        ),
        ((F.col("parsed_from") == "answers_text") | F.col("ce_answer").isNotNull()).alias("seen"),
        F.col("agree_with_dict").alias("ad"),
        F.col("agree_with_ce").alias("ac"),
    )
    scale, nul, seen = F.col("scale"), F.col("nul"), F.col("seen")
    default3 = F.col("three") & ~F.col("has_ev") & seen
    return facts.groupBy("qnum").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(scale).alias("n_scale"),
        F.count_if(~nul & ~scale).alias("n_text"),
        F.count_if(nul).alias("n_null"),
        F.count_if(seen).alias("n_ev_seen"),
        F.count_if(default3).alias("n_default3"),
        F.count_if(nul | default3).alias("n_noinfo"),
        F.count_if(~F.col("ad")).alias("n_dict_differ"),
        F.count("ad").alias("n_dict_comparable"),
        F.count_if(~F.col("ac")).alias("n_ce_differ"),
        F.count("ac").alias("n_ce_comparable"),
    )


def cited_counts(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Answers per question whose (record, run, question) has at least one real URL.

    Both sides are cut to one row per key before they meet, so neither repeated citations nor
    a key with very many answers can multiply or skew the join.
    """
    keys = ["output_id", "run", "qnum"]
    # A run without an index is a run of its own. -1 is no index, so plain equality can be used and the
    # join needs no shuffle beyond those of the two groupings.
    run = F.coalesce("run_id", F.lit(-1)).alias("run")
    asked = (
        answers.filter("qnum is not null")
        .select("output_id", run, "qnum")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cited = (
        citations.filter("qnum is not null and url is not null and url <> ''")
        .select("output_id", run, "qnum")
        .distinct()
    )
    return asked.join(cited, keys, "left_semi").groupBy("qnum").agg(F.sum("n").alias("n_cited"))


def run_agreement(answers: DataFrame, source: str = "prose") -> DataFrame:
    """Per question: records with 2+ runs, and those whose runs all gave one answer.

    "Two distinct values" is min <> max, which aggregates map-side where a distinct count
    would first copy every row once per counted column.
    """
    said = tx.same_text(F.coalesce(chosen_answer(source), F.lit("")))
    return (
        answers.filter("qnum is not null and run_id is not null")
        .select("qnum", "output_id", "run_id", said.alias("said"))
        .groupBy("qnum", "output_id")
        .agg(
            F.min("run_id").alias("r0"),
            F.max("run_id").alias("r1"),
            F.min("said").alias("s0"),
            F.max("said").alias("s1"),
        )
        .filter("r0 <> r1")
        .groupBy("qnum")
        .agg(
            F.count_if(F.col("s0") == F.col("s1")).alias("n_runs_agree"),
            F.count(F.lit(1)).alias("n_runs_multi"),
        )
    )


def question_kind(n_scale: Column, n_text: Column) -> Column:
    """scale, text, mixed or '-', from what was answered."""
    return (
        F.when((n_scale > 0) & (n_text > 0), "mixed")
        .when(n_scale > 0, "scale")
        .when(n_text > 0, "text")
        .otherwise("-")
    )


def scorecard(answers: DataFrame, citations: DataFrame, source: str = "prose") -> DataFrame:
    """One row per question: counts, kind and rates."""
    zero = F.lit(0).cast("bigint")
    rows = (
        question_counts(answers, source)
        .join(cited_counts(answers, citations), "qnum", "left")
        .join(run_agreement(answers, source), "qnum", "left")
        .withColumns(
            {
                c: F.coalesce(F.col(c), zero)
                for c in ("n_cited", "n_runs_agree", "n_runs_multi")
            }
        )
    )
    rates = {
        "null_rate": ("n_null", "n"),
        "default3_rate": ("n_default3", "n_ev_seen"),
        "noinfo_rate": ("n_noinfo", "n"),
        "citation_rate": ("n_cited", "n"),
        "dict_differ_rate": ("n_dict_differ", "n_dict_comparable"),
        "ce_differ_rate": ("n_ce_differ", "n_ce_comparable"),
        "agreement_rate": ("n_runs_agree", "n_runs_multi"),
    }
    return rows.withColumns(
        {
            "kind": question_kind(F.col("n_scale"), F.col("n_text")),
            **{name: tx.ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()},
        }
    )


def drop_candidates(card: DataFrame, top: int = 10) -> DataFrame:
    """The questions whose answers most often carry nothing."""
    return card.orderBy(F.coalesce("noinfo_rate", F.lit(0.0)).desc(), "qnum").limit(top)


def null_rate_by_source(answers: DataFrame) -> DataFrame:
    """NULL answers as each parse sees them, over the rows where that parse has a value."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("prose").alias("source"), F.col("answer_text").alias("a")),
            F.struct(F.lit("citation_evidence").alias("source"), F.col("ce_answer").alias("a")),
        )
    )
    return (
        answers.select(sides.alias("s"))
        .select("s.*")
        .groupBy("source")
        .agg(F.count_if(tx.is_null_word(F.col("a"))).alias("n_null"), F.count("a").alias("n"))
        .withColumn("null_rate", tx.ratio(F.col("n_null"), F.col("n")))
    )


def parsed_from_counts(answers: DataFrame) -> DataFrame:
    """Answers by the parse that supplied them."""
    return answers.groupBy(F.coalesce("parsed_from", F.lit("<unset>")).alias("parsed_from")).agg(
        F.count(F.lit(1)).alias("n")
    )


def blind_answers(card: DataFrame) -> DataFrame:
    """How many answers no parse could have seen evidence for. One row."""
    return card.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"),
        F.coalesce(F.sum("n_ev_seen"), F.lit(0)).alias("n_ev_seen"),
        F.coalesce(F.sum(F.col("n") - F.col("n_ev_seen")), F.lit(0)).alias("n_blind"),
    )


def subqueries_per_run(
    runs: DataFrame, queries: DataFrame, answers: DataFrame, asked: int = QUESTIONS_ASKED
) -> DataFrame:
    """Query entries per log run against the number of questions asked. One row.

    Runs and queries meet as a union summed by run key: one shuffle, no join to skew.
    """
    keys = ["se10", "run_key"]
    per_run = (
        runs.select(*keys, F.lit(1).alias("is_run"), F.lit(0).alias("q"))
        .unionByName(queries.select(*keys, F.lit(0).alias("is_run"), F.lit(1).alias("q")))
        .groupBy(*keys)
        .agg(F.max("is_run").alias("is_run"), F.sum("q").alias("q"))
        .filter("is_run = 1")
        .select("q", F.lit(0).alias("side"))
    )
    answered = (
        answers.filter("run_id is not null")
        .select("output_id", "run_id")
        .distinct()
        .select(F.lit(0).cast("bigint").alias("q"), F.lit(1).alias("side"))
    )
    log = F.col("side") == 0
    return (
        per_run.unionByName(answered)
        .agg(
            F.count_if(log).alias("n_log_runs"),
            F.count_if(~log).alias("n_output_runs"),
            F.coalesce(F.sum("q"), F.lit(0)).alias("n_queries"),
            F.count_if(log & (F.col("q") == asked)).alias("n_exact"),
            F.count_if(log & (F.abs(F.col("q") - asked) <= 2)).alias("n_within_2"),
        )
        .withColumns(
            {
                "per_run": tx.ratio(F.col("n_queries"), F.col("n_log_runs")),
                "same_population": F.col("n_log_runs") == F.col("n_output_runs"),
            }
        )
    )
