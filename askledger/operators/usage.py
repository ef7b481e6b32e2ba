"""Token and call volume, what it costs, prompt-cache statistics, citation overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.functions import text as tx

UNSET = "<unset>"
# Fixed value: a request without a tier is priced as this one.
DEFAULT_TIER = "standard"
# Shortest prefix a provider caches, and the rough size of a token.
CACHE_MIN_TOKENS = 1024
CHARS_PER_TOKEN = 4
# Share of cited URLs from which opening pages explains citations.
COVERED_AT = 0.8

RATE_FIELDS = (
    "input_per_mtok",
    "cached_input_per_mtok",
    "output_per_mtok",
    "fee_per_1k_search_calls",
)
RATES_SCHEMA = "tier string, " + ", ".join(f"{f} double" for f in RATE_FIELDS)


def rates_table(
    spark: SparkSession, tiers: Mapping[str, Mapping[str, float | None] | None]
) -> DataFrame:
    """Rates as a DataFrame: one row per tier, a missing rate is NULL."""
    rows = [
        (tier, *[None if (v := (r or {}).get(f)) is None else float(v) for f in RATE_FIELDS])
        for tier, r in tiers.items()
    ]
    return spark.createDataFrame(rows, RATES_SCHEMA)


def _tokens(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def usage(runs: DataFrame, calls: DataFrame, queries: DataFrame, by: Sequence[str] = ("tier",)) -> DataFrame:
    """Runs, tokens, calls and query entries by tier, or by run index and tier.

    Calls and queries are counted per run key before they meet the runs, so a busy run is one
    row by then. Calls that belong to no run stay, under the unset tier. The three sides
    are unioned and summed: a tier seen on one side only still gets its row. A call
    is counted under its own run index, a run under its own.
    """
    keys = ["se10", "run_key"]
    zero = F.lit(0).cast("bigint")
    counted = (
        calls.select(*keys, "run_id", F.lit(1).alias("c"), F.lit(0).alias("q"))
        .unionByName(queries.select(*keys, "run_id", F.lit(0).alias("c"), F.lit(1).alias("q")))
        .groupBy(*keys, "run_id")
        .agg(F.sum("c").alias("n_calls"), F.sum("q").alias("n_entries"))
    )
    tiers = runs.select(*keys, "service_tier")
    call_side = (
        counted.join(tiers, keys, "left")
        .select(
            "run_id",
            F.coalesce("service_tier", F.lit(UNSET)).alias("tier"),
            *[zero.alias(c) for c in ("n_runs", "input_tokens", "cache_read", "output_tokens")],
            "n_calls",
            "n_entries",
        )
    )
    run_side = runs.select(
        "run_id",
        F.coalesce("service_tier", F.lit(UNSET)).alias("tier"),
        F.lit(1).cast("bigint").alias("n_runs"),
        "input_tokens",
        "cache_read",
        "output_tokens",
        zero.alias("n_calls"),
        zero.alias("n_entries"),
    )
    sums = ("n_runs", "input_tokens", "cache_read", "output_tokens", "n_calls", "n_entries")
    return run_side.unionByName(call_side).groupBy(*by).agg(*[_tokens(c) for c in sums])


def token_cost(full: Column, cached: Column, output: Column, calls: Column) -> Column:
    """Cost from volumes and the rate columns in scope; NULL when a token rate is missing.

    Cached tokens are part of the input and reasoning tokens part of the output, so neither
    adds a term. Every call pays the fee, whatever its action.
    """
    return (
        (full - cached) * F.col("input_per_mtok") / F.lit(1e6)
        + cached * F.col("cached_input_per_mtok") / F.lit(1e6)
        + output * F.col("output_per_mtok") / F.lit(1e6)
        + call_fee(calls)
    )


def call_fee(calls: Column) -> Column:
    """Fee for calls under the rate columns in scope; zero when the fee is not set."""
    return F.coalesce(calls * F.col("fee_per_1k_search_calls") / F.lit(1000), F.lit(0.0))


def with_cost(used: DataFrame, rates: DataFrame) -> DataFrame:
    """Add cost and fee. The rates table is configuration: one row per tier, a handful."""
    priced_as = F.when(F.col("tier") == UNSET, DEFAULT_TIER).otherwise(F.col("tier"))
    r = F.broadcast(rates.withColumnRenamed("tier", "_tier"))
    return (
        used.join(r, priced_as == F.col("_tier"), "left")
        .withColumns(
            {
                "cost": token_cost(
                    F.col("input_tokens"), F.col("cache_read"), F.col("output_tokens"), F.col("n_calls")
                ),
                "fee": call_fee(F.col("n_calls")),
            }
        )
        .select(*used.columns, "cost", "fee")
    )


def total_cost(priced: DataFrame) -> DataFrame:
    """Sum over priced tiers, and whether it leaves some out or prices an unset tier. One row."""
    return priced.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"),
        F.coalesce(F.bool_or(F.col("cost").isNull()), F.lit(False)).alias("excludes_unpriced"),
        F.coalesce(F.bool_or(F.col("tier") == UNSET), F.lit(False)).alias("unset_at_standard"),
    )


def missing_rates(rates: DataFrame) -> DataFrame:
    """tier.field for every rate that is not set."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rate")) for f in RATE_FIELDS])
    )
    return (
        rates.select("tier", pairs.alias("p"))
        .filter("p.rate is null")
        .select(F.concat_ws(".", "tier", "p.field").alias("missing"))
    )


def pricing_verified(rates: DataFrame) -> DataFrame:
    """True when there are tiers and none lacks a rate. One row."""
    unset = F.array_contains(F.array(*[F.col(f).isNull() for f in RATE_FIELDS]), True)
    return rates.agg(
        ((F.count(F.lit(1)) > 0) & (F.count_if(unset) == 0)).alias("is_verified"),
        F.count(F.lit(1)).alias("n_tiers"),
    )


def cache_by_run(runs: DataFrame) -> DataFrame:
    """Cached share of input, in total and per run index.

    `scope` tells the total from the rows of runs whose index could not be read.
    """
    used = (
        runs.rollup("run_id")
        .agg(
            F.grouping_id().alias("_all"),
            F.count(F.lit(1)).alias("n_runs"),
            _tokens("input_tokens"),
            _tokens("cache_read"),
        )
    )
    share = tx.ratio(F.col("cache_read"), F.col("input_tokens"))
    return used.select(
        F.when(F.col("_all") == 1, "total").otherwise("run").alias("scope"),
        "run_id",
        "n_runs",
        "input_tokens",
        "cache_read",
        F.coalesce(share, F.lit(0.0)).alias("hit_rate"),
    )


def shared_prefix(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Longest prefix shared by all texts, with their count and mean length.

    The prefix of a whole set is the prefix of its smallest and its largest member, so one
    min/max aggregate replaces any comparison between rows.
    """
    text = F.col(column)
    sized = df.filter(text.isNotNull() & (text != "")).groupBy(*by).agg(
        F.min(text).alias("_lo"),
        F.max(text).alias("_hi"),
        F.count(F.lit(1)).alias("n_prompts"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_chars"),
    )
    differs = F.zip_with(
        F.split("_lo", ""), F.split("_hi", ""), lambda x, y: ~x.eqNullSafe(y)
    )
    at = F.array_position(differs, True)
    prefix = F.when(at > 0, at - 1).otherwise(F.length("_lo"))
    chars = F.coalesce(prefix, F.lit(0)).cast("bigint")
    tokens = F.floor(chars / CHARS_PER_TOKEN)
    return sized.select(
        *by,
        "n_prompts",
        chars.alias("prefix_chars"),
        F.coalesce(F.expr("try_divide(_chars, n_prompts)").cast("bigint"), F.lit(0).cast("bigint")).alias(
            "avg_prompt_chars"
        ),
        tokens.alias("prefix_tokens"),
        (tokens >= CACHE_MIN_TOKENS).alias("reaches_floor"),
    )


def url_overlap(
    cited: DataFrame, opened: DataFrame, key: str = "se10", covered_at: float = COVERED_AT
) -> DataFrame:
    """Cited against opened URLs, each counted once per `key`. One row.

    Both sides go through one grouping on (key, url); a URL is cited, opened or both by flags.
    """
    real = "url is not null and url <> ''"
    sides = (
        cited.filter(real)
        .select(key, "url", F.lit(1).alias("c"), F.lit(0).alias("o"))
        .unionByName(
            opened.filter(real)
            .filter("action_type = 'open_page'")
            .select(key, "url", F.lit(0).alias("c"), F.lit(1).alias("o"))
        )
        .groupBy(key, "url")
        .agg(F.max("c").alias("c"), F.max("o").alias("o"))
    )
    share = F.coalesce(tx.ratio(F.col("n_both"), F.col("cited_urls")), F.lit(0.0))
    return sides.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("cited_urls"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("opened_urls"),
        F.count_if((F.col("c") == 1) & (F.col("o") == 1)).alias("n_both"),
    ).withColumns({"covered": share, "mostly_opened": share >= covered_at})


def token_summary(runs: DataFrame) -> DataFrame:
    """Token totals, cached and reasoning shares. One row."""
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[_tokens(c) for c in ("input_tokens", "cache_read", "output_tokens", "reasoning")],
    ).withColumns(
        {
            "hit_rate": tx.ratio(F.col("cache_read"), F.col("input_tokens")),
            "reasoning_share": tx.ratio(F.col("reasoning"), F.col("output_tokens")),
        }
    )


def tier_mix(runs: DataFrame, unset: str = UNSET) -> DataFrame:
    """Runs per service tier."""
    return runs.groupBy(F.coalesce("service_tier", F.lit(unset)).alias("tier")).agg(
        F.count(F.lit(1)).alias("n")
    )
