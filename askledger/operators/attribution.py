"""Which search query led to a citation: the logs do not say, so the queries of the entity are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askledger.operators.skew import HOT_ROWS, spread_join

#: Points for the cited host in the query, for all words of the question in it, for the same run.
DOMAIN, OVERLAP, SAME_RUN = 100, 60, 20
MARGIN = 10
# Queries in one packed row at most, about: an entity with more has several rows.
PACKED_QUERIES = 1024


def words(text: Column) -> Column:
    """Distinct lower-case words; empty for NULL."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def hosts(text: Column) -> Column:
    """Distinct host names in a text, without a leading www; empty for NULL."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9-]+(\.[a-z0-9-]+)+"), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(found, bare_host)), F.array().cast("array<string>"))


def pack_queries(queries: DataFrame, limit: int = PACKED_QUERIES) -> DataFrame:
    """Distinct queries of an entity with their hosts and words: se10, said. One row for about `limit` rows of an entity."""
    said = queries.filter("query_text is not null and se10 is not null").select("se10", F.col("run_id").alias("query_run"), "query_text")
    parts = said.groupBy("se10").agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("_parts"))
    query = F.struct("query_text", "query_run")
    return (
        said.join(parts, "se10")
        .groupBy("se10", F.pmod(F.xxhash64("query_text", "query_run"), F.col("_parts")).alias("_part"))
        .agg(F.collect_set(query).alias("said"))
        .select(
            "se10",
            F.transform(
                "said",
                lambda q: F.struct(
                    q["query_text"].alias("query_text"), q["query_run"].alias("query_run"),
                    hosts(q["query_text"]).alias("hosts"), words(q["query_text"]).alias("words"),
                ),
            ).alias("said"),
        )
    )


def best_queries(
    citations: DataFrame, queries: DataFrame, margin: int = MARGIN, min_rows: int = HOT_ROWS, limit: int = PACKED_QUERIES
) -> DataFrame:
    """Per distinct (se10, run_id, domain, question) of the citations: the best query of the entity and its score, the
    score of the runner-up, and whether the two are within `margin`.

    `citations` has se10, run_id, domain, question; `queries` has se10, run_id, query_text. Citations and queries are made
    distinct first; a citation meets its entity's queries packed in rows of about `limit`, and only the best two of each
    row leave it, so neither words nor candidates are ever shuffled. Only queries that share a host or a word are scored; a
    citation that shares none keeps its row, without a query. Entities with many citations are cut into pieces.
    Of equal scores the first text, then the lowest run wins. A NULL run is the same as no run.
    """
    key = ["se10", "run_id", "domain", "question"]
    cited = citations.groupBy(*key).agg(F.count(F.lit(1)).alias("n_citations"))
    wanted = cited.select(
        *key, "n_citations",
        F.when(F.col("domain") != "", bare_host(F.col("domain"))).alias("_host"), words(F.col("question")).alias("_asked"),
    )
    met = spread_join(wanted, pack_queries(queries, limit), ["se10"], "left", min_rows=min_rows)

    def counted(q: Column) -> Column:
        same = F.coalesce(F.col("run_id") == q["query_run"], F.lit(False)).cast("int")
        return F.struct(
            F.coalesce(F.array_contains(q["hosts"], F.col("_host")), F.lit(False)).cast("int").alias("n_hosts"),
            F.size(F.array_intersect(q["words"], F.col("_asked"))).alias("shared"),
            (same * SAME_RUN).alias("same"),
            q["query_text"].alias("query_text"), q["query_run"].alias("query_run"),
        )

    def scored(q: Column) -> Column:
        n_words = F.size("_asked")
        overlap = F.when(n_words > 0, F.floor(F.lit(OVERLAP) * q["shared"] / n_words)).otherwise(0)
        score = (q["n_hosts"] * DOMAIN + overlap + q["same"]).cast("bigint")
        return F.struct((-score).alias("minus"), q["query_text"].alias("query_text"), q["query_run"].alias("query_run"))

    sharing = F.filter(F.transform("said", counted), lambda q: (q["n_hosts"] > 0) | (q["shared"] > 0))
    two = F.slice(F.sort_array(F.transform(sharing, scored)), 1, 2)
    found = met.select(*key, "n_citations", F.explode_outer(two).alias("q")).select(
        *key, "n_citations", "q.query_text", "q.query_run", (-F.col("q.minus")).alias("score")
    )
    ranks = Window.partitionBy(*key).orderBy(F.col("score").desc_nulls_last(), "query_text", "query_run")
    top = found.withColumn("_rn", F.row_number().over(ranks)).filter("_rn <= 2")
    first = F.col("_rn") == 1
    return (
        top.groupBy(*key)
        .agg(
            F.max("n_citations").alias("n_citations"),
            *[F.max(F.when(first, F.col(c))).alias(c) for c in ("query_text", "query_run", "score")],
            F.max(F.when(~first, F.col("score"))).alias("runner_up"),
        )
        .withColumn("is_ambiguous", F.coalesce(F.col("score") - F.col("runner_up") <= margin, F.lit(False)))
    )
