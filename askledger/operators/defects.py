"""Which output runs are broken, how, and whether the defects are one and the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import text as tx

# When two sets of defects count as one, or as unrelated.
SAME_ABOVE = 0.9
UNRELATED_BELOW = 0.1

# How a run's prose parsed, and where else the run is known.
STATES = ("prose ok", "prose partial", "prose UNREADABLE")
PLACES = ("in logs", "OUTPUT-ONLY")


def log_runs(runs: DataFrame) -> DataFrame:
    """Distinct (entity, run index) on the log side."""
    return runs.filter("run_id is not null").select("se10", "run_id").distinct()


def dict_runs(answers: DataFrame) -> DataFrame:
    """Per output run: answers, and those only the dict supplied."""
    return (
        answers.filter("run_id is not null")
        .groupBy("output_id", "run_id")
        .agg(
            F.count(F.lit(1)).alias("n_answers"),
            F.count_if(F.col("parsed_from") == "answer_dict").alias("n_dict"),
        )
    )


def run_defects(answers: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per output run with its defect label; healthy runs are there too."""
    known = log_runs(runs).withColumn("has_log", F.lit(True))
    rows = (
        dict_runs(answers)
        .join(records.select("output_id", "se10", "src_file", "src_line"), "output_id")
        .join(known, ["se10", "run_id"], "left")
    )
    total = F.col("n_dict") == F.col("n_answers")
    some = F.col("n_dict") > 0
    rows = rows.withColumns(
        {"total_fail": total, "any_dict": some, "has_log": F.coalesce("has_log", F.lit(False))}
    )
    return rows.select(
        defect_label(F.col("total_fail"), F.col("any_dict"), F.col("has_log")).alias("defect"),
        "se10", "src_file", "src_line", "output_id", "run_id", "n_dict", "n_answers",
        "total_fail", "any_dict", "has_log",
    )


def defect_label(total_fail: Column, any_dict: Column, has_log: Column) -> Column:
    """Names of a run's defects joined by '+', or ok."""
    label = F.concat_ws(
        "+",
        F.when(total_fail, "prose_unreadable").when(any_dict, "prose_partial"),
        F.when(~has_log, "output_only"),
    )
    return F.when(label == "", "ok").otherwise(label)


def prose_state() -> Column:
    return (
        F.when(F.col("total_fail"), STATES[2]).when(F.col("any_dict"), STATES[1]).otherwise(STATES[0])
    )


def defect_crosstab(defects: DataFrame) -> DataFrame:
    """Prose state against presence in the logs; all six cells, empty ones as zero.

    The cells are counted in one pass and laid out afterwards: no pivot on data values.
    """
    cells = [
        F.count_if((F.col("state") == s) & (F.col("has_log") == (p == PLACES[0]))).alias(f"c{i}{j}")
        for i, s in enumerate(STATES)
        for j, p in enumerate(PLACES)
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(s).alias("state"), F.col(f"c{i}0").alias("in_logs"), F.col(f"c{i}1").alias("output_only")
            )
            for i, s in enumerate(STATES)
        ]
    )
    return defects.withColumn("state", prose_state()).agg(*cells).select(F.inline(table))


def defect_overlap(defects: DataFrame) -> DataFrame:
    """Share of the smaller defect set that is in both, and what it says. One row."""
    lost = ~F.col("has_log")
    counts = defects.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("total_fail")).alias("n_unreadable"),
        F.count_if(lost).alias("n_output_only"),
        F.count_if(F.col("total_fail") & lost).alias("n_both"),
    )
    share = tx.ratio(
        F.col("n_both"), F.least("n_unreadable", "n_output_only")
    )
    return counts.withColumn("overlap", share).withColumn(
        "verdict",
        F.when(F.col("overlap") > SAME_ABOVE, "same")
        .when(F.col("overlap") < UNRELATED_BELOW, "independent")
        .when(F.col("overlap").isNotNull(), "partial"),
    )


def defect_files(defects: DataFrame) -> DataFrame:
    """Defective runs per source file."""
    return (
        defects.filter("any_dict or not has_log")
        .groupBy("src_file")
        .agg(F.count(F.lit(1)).alias("n_defective"))
    )


def defect_pointers(defects: DataFrame) -> DataFrame:
    """The first place to look at for each defect: log-side runs first, then by file and line."""
    place = F.struct("has_log", ~F.col("total_fail"), "src_file", "src_line", "run_id")
    kinds = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("total_fail"), "prose_unreadable"),
                F.when(~F.col("has_log"), "output_only"),
            )
        )
    )
    return (
        defects.select(kinds.alias("kind"), place.alias("p"), "src_file", "src_line")
        .groupBy("kind")
        .agg(F.min_by(F.struct("src_file", "src_line"), "p").alias("at"))
        .select("kind", "at.*")
    )


# Which runs go to which export file; a run with both defects goes to both.
EXPORTS = {
    "prose_unreadable": "total_fail",
    "prose_partial": "any_dict and not total_fail",
    "output_only": "not has_log",
}


def defect_exports(defects: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per defect."""
    return {name: defects.filter(condition) for name, condition in EXPORTS.items()}
