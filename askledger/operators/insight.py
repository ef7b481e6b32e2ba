"""Further reads of the tables: how answers spread, the fullest record, calls by position, what a cap would save,
what a question says about a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.operators import usage
from askledger.operators.scorecard import chosen_answer
from askledger.operators.skew import keep_first


def answer_spread(answers: DataFrame, source: str = "prose") -> DataFrame:
    """Per question, over its records: mean share of the most frequent answer and mean entropy, in bits.

    Answers are counted per (record, question, answer) first; everything after that is sums of counts.
    """
    said = tx.same_text(F.coalesce(chosen_answer(source), F.lit("")))
    cells = (
        answers.filter("qnum is not null and run_id is not null")
        .groupBy("qnum", "output_id", said.alias("said"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("qnum", "output_id")
        .agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))
    )
    entropy = F.log2("n") - F.col("clogc") / F.col("n")
    return cells.groupBy("qnum").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.round(F.avg(F.col("most") / F.col("n")), 6).alias("majority_share"),
        F.round(F.avg(F.greatest(entropy, F.lit(0.0))), 6).alias("entropy"),
        F.count_if(F.col("most") * 2 > F.col("n")).alias("n_majority"),
    )


def fullest_records(records: DataFrame, order: Sequence[str], runs: str = "n_answer_runs") -> DataFrame:
    """Of the records of one entity the one with most runs; of equals the last in `order`."""
    return keep_first(records.filter("se10 is not null"), ["se10"], [F.desc(runs), *[F.desc(c) for c in order]])


def calls_by_position(calls: DataFrame, citations: DataFrame) -> DataFrame:
    """Per place in the run: how many calls of each kind, and how many of the opened pages are cited."""
    cited = citations.filter("url <> ''").select("se10", "url").distinct().withColumn("is_cited", F.lit(True))
    kind = F.col("action_type")
    opened = (kind == "open_page") & (F.coalesce("url", F.lit("")) != "")
    counted = calls.groupBy("call_index", "se10", kind, F.when(opened, F.col("url")).alias("url")).agg(
        F.count(F.lit(1)).alias("n")
    )

    def total(name: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    has_url = F.col("url").isNotNull()
    return (
        counted.join(cited, ["se10", "url"], "left")
        .groupBy("call_index")
        .agg(
            F.sum("n").alias("n_calls"),
            total("n_search", kind == "search"),
            total("n_open_page", kind == "open_page"),
            total("n_find_in_page", kind == "find_in_page"),
            total("n_opened", has_url),
            total("n_cited", has_url & F.col("is_cited").isNotNull()),
        )
        .withColumn("cited_share", tx.ratio(F.col("n_cited"), F.col("n_opened")))
    )


def calls_per_entity(calls: DataFrame) -> DataFrame:
    """Median, ninth decile and largest number of calls of an entity. One row."""
    per = calls.groupBy("se10").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_calls"), F.percentile("n", 0.5).alias("median_calls"),
        F.percentile("n", 0.9).alias("p90_calls"), F.max("n").alias("most_calls"),
    )


def capped_usage(
    runs: DataFrame, calls: DataFrame, queries: DataFrame, by: Sequence[str], last_index: int
) -> DataFrame:
    """Usage as if every run had stopped calling after `last_index`; tokens stay as they were."""
    kept = F.col("call_index") <= last_index
    return usage.usage(runs, calls.filter(kept), queries.filter(kept), by)


def label_value(answers: DataFrame, labels: DataFrame, source: str = "prose") -> DataFrame:
    """Per question: share of labelled entities among its NULL answers, among the others, and their difference.

    `labels` has one row per entity (se10, label as 0 or 1). Answers are counted per entity before the join.
    """
    said = F.lower(F.trim(F.coalesce(chosen_answer(source), F.lit("")))) == "null"
    counted = answers.filter("qnum is not null").groupBy("qnum", "se10").agg(
        F.count_if(said).alias("n_null"), F.count_if(~said).alias("n_said")
    )
    return (
        counted.join(labels.select("se10", "label"), "se10")
        .groupBy("qnum")
        .agg(
            F.sum("n_null").alias("n_null"), F.sum(F.col("n_null") * F.col("label")).alias("n_null_labelled"),
            F.sum("n_said").alias("n_said"), F.sum(F.col("n_said") * F.col("label")).alias("n_said_labelled"),
        )
        .withColumn("null_rate", tx.ratio(F.col("n_null_labelled"), F.col("n_null")))
        .withColumn("said_rate", tx.ratio(F.col("n_said_labelled"), F.col("n_said")))
        .withColumn("gap", F.col("null_rate") - F.col("said_rate"))
    )
