"""Anomaly rows: one schema for every detector, and the reads over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.operators.skew import numbered

DEFAULT_SAMPLE = 5

SCHEMA = (
    "stage string, code string, se10 string, src_file string, src_line bigint, "
    "raw_excerpt string, context string, detail string, ts_recorded timestamp, seq bigint"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]

# A problem found inside one row, before it becomes an anomaly row.
PROBLEM = "struct<code:string,excerpt:string,detail:string>"


def problem(code: str, detail: Column, excerpt: Column | None = None) -> Column:
    """One problem as a struct, to be collected in an array and exploded later."""
    return F.named_struct(
        F.lit("code"),
        F.lit(code),
        F.lit("excerpt"),
        (F.lit(None) if excerpt is None else excerpt).cast("string"),
        F.lit("detail"),
        detail.cast("string"),
    ).cast(PROBLEM)


def problems(*checks: tuple[Column, Column]) -> Column:
    """array of the problems whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, p) for cond, p in checks]))


def truncated(text: Column, limit: int | None = None) -> Column:
    """The whole text; with a limit, at most that many characters and a note when it was cut."""
    if limit is None:
        return text
    size = F.length(text)
    return F.when(
        size > limit,
        F.concat(F.substring(text, 1, limit), F.format_string("... [truncated, %d chars total]", size)),
    ).otherwise(text)


def anomaly(
    df: DataFrame,
    stage: str,
    code: str | Column,
    detail: Column,
    excerpt: Column | None = None,
    context: Column | None = None,
    seq: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One anomaly per row of `df`; provenance columns are taken when `df` has them. `limit` cuts excerpts."""
    has = set(df.columns)

    def own(name: str, kind: str) -> Column:
        return (F.col(name) if name in has else F.lit(None)).cast(kind).alias(name)

    none = F.lit(None).cast("string")
    return df.select(
        F.lit(stage).alias("stage"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        own("se10", "string"),
        own("src_file", "string"),
        own("src_line", "bigint"),
        truncated(none if excerpt is None else excerpt, limit).alias("raw_excerpt"),
        (none if context is None else context).alias("context"),
        detail.cast("string").alias("detail"),
        F.current_timestamp().alias("ts_recorded"),
        (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"),
    )


def run_number(*run: Column) -> Column:
    """A number that keeps the problems of the runs of one line apart, with room for 2^32 of them."""
    return F.shiftleft(F.pmod(F.xxhash64(*run), F.lit(1 << 30)), 32)


def from_problems(df: DataFrame, stage: str, column: str = "problems", base: int | Column = 0) -> DataFrame:
    """Anomaly rows from an array of problems; `base` keeps several arrays of a line apart."""
    keep = [c for c in ("se10", "src_file", "src_line") if c in df.columns]
    base = base if isinstance(base, Column) else F.lit(base)
    flat = df.select(*keep, base.alias("_base"), F.posexplode(column).alias("_pos", "_p"))
    return anomaly(
        flat, stage, F.col("_p.code"), F.col("_p.detail"), F.col("_p.excerpt"),
        seq=F.col("_pos") + F.col("_base"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def cap_payload(anomalies: DataFrame, rows: int | None = None, width: int = 100_000) -> DataFrame:
    """All anomalies as they are; with `rows`, excerpt and context only on the first `rows` rows of a code in a file.

    Every row stays. A file in which one code fires on each line is numbered range by range.
    """
    if rows is None:
        return anomalies
    ranked = numbered(
        anomalies, ["stage", "code", "src_file"], "src_line",
        ["src_line", "seq", "detail"], width, "_rn",
    )
    kept = F.col("_rn") <= rows
    return ranked.withColumns(
        {c: F.when(kept, F.col(c)) for c in ("raw_excerpt", "context")}
    ).drop("_rn")


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Rows and distinct files per code and stage, most frequent first."""
    return (
        anomalies.groupBy("code", "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src_file").alias("n_files"))
        .orderBy(F.desc("n"), "code", "stage")
    )


def anomaly_samples(
    anomalies: DataFrame, code: str, limit: int = DEFAULT_SAMPLE, width: int = 100_000
) -> DataFrame:
    """A few rows of one code: those with text first, spread over the files."""
    chosen = numbered(
        anomalies.filter(F.col("code") == code), ["src_file"], "src_line",
        ["src_line", "seq", "stage", "detail"], width, "rn",
    )
    bare = F.col("context").isNull() & F.col("raw_excerpt").isNull()
    return chosen.orderBy(bare, "rn", "src_file", "src_line", "seq", "stage", "detail").limit(limit)
