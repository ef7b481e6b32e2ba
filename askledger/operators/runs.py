"""What repeat runs cost, and whether the third run changes an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.operators.scorecard import chosen_answer

# Runs kept by the cut scenario.
KEEP_RUNS = 2


def run_slices(priced: DataFrame) -> DataFrame:
    """One row per run index from (run index, tier) rows; cost is NULL if any tier is unpriced."""
    unpriced = F.count_if(F.col("cost").isNull())
    sums = ("n_runs", "n_calls", "input_tokens", "cache_read", "output_tokens")
    return (
        priced.groupBy("run_id")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.when(unpriced == 0, F.sum("cost")).alias("cost"),
            F.sum("fee").alias("fee"),
        )
        .withColumn("hit_rate", tx.ratio(F.col("cache_read"), F.col("input_tokens")))
    )


def unpriced_tiers(priced: DataFrame) -> DataFrame:
    """Tiers seen in the data that have no usable rates."""
    return priced.filter("cost is null").select("tier").distinct()


def count_distribution(df: DataFrame, key: str = "se10") -> DataFrame:
    """How many keys have n rows, for every n."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_runs"))
        .groupBy("n_runs")
        .agg(F.count(F.lit(1)).alias("n_entities"))
    )


def cut_to(slices: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """What leaving out run indexes from `keep` on would remove. One row."""
    cut = F.coalesce(F.col("run_id") >= keep, F.lit(False))
    all_priced = F.count_if(F.col("cost").isNull()) == 0
    cut_priced = F.count_if(cut & F.col("cost").isNull()) == 0
    some_cut = F.count_if(cut) > 0

    def removed(column: str):
        return F.coalesce(F.sum(F.when(cut, F.col(column))), F.lit(0))

    return slices.agg(
        removed("n_runs").alias("cut_runs"),
        removed("n_calls").alias("cut_calls"),
        F.coalesce(F.sum("n_runs"), F.lit(0)).alias("n_runs"),
        F.when(some_cut & cut_priced, F.sum(F.when(cut, F.col("cost")))).alias("cut_cost"),
        F.sum(F.when(cut, F.col("fee"))).alias("cut_fee"),
        F.when(all_priced, F.sum("cost")).alias("total_cost"),
    ).withColumns(
        {
            "cut_runs_share": tx.ratio(F.col("cut_runs"), F.col("n_runs")),
            "cut_cost_share": tx.ratio(F.col("cut_cost"), F.col("total_cost")),
        }
    )


def first_three(answers: DataFrame, source: str = "prose") -> DataFrame:
    """Per (record, question): row count and the first three normalized answers by run index.

    Only three rows of a group are ever ranked together: Spark cuts each group to three per
    task before the shuffle. The full count is a separate map-side aggregate.
    """
    keys = ["output_id", "qnum"]
    said = tx.same_text(F.coalesce(chosen_answer(source), F.lit("")))
    rows = answers.filter("qnum is not null and run_id is not null")
    ranked = (
        rows.select(*keys, "run_id", "ord", said.alias("a"))
        .withColumn(
            "rn", F.row_number().over(Window.partitionBy(*keys).orderBy("run_id", "ord", "a"))
        )
        .filter("rn <= 3")
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("rn") == i + 1, F.col("a"))).alias(f"a{i}") for i in range(3)])
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.join(ranked, keys, "inner")


def third_run(answers: DataFrame, source: str = "prose") -> DataFrame:
    """Per question: is the third run redundant, decisive, or is there no majority."""
    three, pair = F.col("n_rows") >= 3, F.col("n_rows") == 2
    same01 = F.col("a0") == F.col("a1")
    settles = (F.col("a2") == F.col("a0")) | (F.col("a2") == F.col("a1"))
    rates = {
        "redundant_rate": ("n_redundant", "n_three"),
        "decisive_rate": ("n_decisive", "n_three"),
        "no_majority_rate": ("n_no_majority", "n_three"),
        "pair_agreement": ("n_pairs_agree", "n_pairs"),
    }
    return (
        first_three(answers, source)
        .groupBy("qnum")
        .agg(
            F.count_if(three).alias("n_three"),
            F.count_if(three & same01).alias("n_redundant"),
            F.count_if(three & ~same01 & settles).alias("n_decisive"),
            F.count_if(three & ~same01 & ~settles).alias("n_no_majority"),
            F.count_if(pair).alias("n_pairs"),
            F.count_if(pair & same01).alias("n_pairs_agree"),
        )
        .withColumns({name: tx.ratio(F.col(a), F.col(b)) for name, (a, b) in rates.items()})
    )


def third_run_totals(per_question: DataFrame, runs: DataFrame) -> DataFrame:
    """Sums over questions, and the gap between answer records and entities with 3+ runs. One row.

    The two one-row sides are unioned and summed.
    """
    sums = ("n_three", "n_redundant", "n_decisive", "n_no_majority", "n_pairs", "n_pairs_agree")
    zero = F.lit(0).cast("bigint")
    answers_side = per_question.agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in sums],
        F.coalesce(F.max("n_three"), zero).alias("n_records"),
        F.count(F.lit(1)).alias("n_questions"),
        zero.alias("n_log_three"),
    )
    log_side = (
        runs.groupBy("se10")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") >= 3).alias("n_log_three"))
        .select(*[zero.alias(c) for c in (*sums, "n_records", "n_questions")], "n_log_three")
    )
    columns = (*sums, "n_records", "n_questions", "n_log_three")
    return (
        answers_side.unionByName(log_side)
        .agg(*[F.sum(c).alias(c) for c in columns])
        .withColumns(
            {
                "uniform": F.col("n_three") == F.col("n_records") * F.col("n_questions"),
                "population_gap": F.abs(F.col("n_records") - F.col("n_log_three")),
                "redundant_rate": tx.ratio(F.col("n_redundant"), F.col("n_three")),
                "decisive_rate": tx.ratio(F.col("n_decisive"), F.col("n_three")),
                "no_majority_rate": tx.ratio(F.col("n_no_majority"), F.col("n_three")),
                "pair_agreement": tx.ratio(F.col("n_pairs_agree"), F.col("n_pairs")),
            }
        )
    )


def least_conclusive(per_question: DataFrame, top: int = 10) -> DataFrame:
    """The questions where three runs most often give three answers."""
    rate = F.coalesce("no_majority_rate", F.lit(0.0))
    return per_question.orderBy(rate.desc(), "qnum").limit(top)
