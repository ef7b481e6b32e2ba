"""The domain tables, read out of the shared test tables.

Each view covers every row of the tables it is made from. Views are plain projections and
in-row explodes; those that make several wide rows of one first deal a large table over more parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.operators.usage import rates_table

# Example rates: two tiers without any, as in a half-filled price list.
RATES = {
    "standard": {
        "input_per_mtok": 2.5,
        "cached_input_per_mtok": 0.25,
        "output_per_mtok": 15.0,
        "fee_per_1k_search_calls": 10.0,
    },
    "default": {
        "input_per_mtok": 2.5,
        "cached_input_per_mtok": 0.25,
        "output_per_mtok": 15.0,
        "fee_per_1k_search_calls": 10.0,
    },
    "flex": {},
    "priority": {},
}


#: Rows of a table that one task turns into lines and parses, about.
PARSED_ROWS = 50_000
#: Rows of a table that one task turns into six rows each, about: a task holds what it shuffles.
EXPLODED_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, part_rows: int = PARSED_ROWS) -> DataFrame:
    """A table in parts of about `part_rows` rows, in as many as there are cores at least: parsing costs far more than
    moving narrow rows once, and a task's time and memory must not follow the size of the table.

    A table whose scan splits it nearly as evenly is left as it is: what counts is the rows of the largest split, as a
    row group is read whole by one split and the others beside it get none. The number is given, so that adaptive
    execution does not merge the parts again.
    """
    df = table(spark, sf_dir, name)
    split = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = split.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // part_rows))
    return df if largest * parts <= 2 * rows else df.repartition(parts, df.columns[0])


def rates(spark: SparkSession) -> DataFrame:
    return rates_table(spark, RATES)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an entity with 1-4 runs; some run keys cannot be read."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "*", "explode(sequence(0, cast(o_orderkey % 4 as int))) as k"
        )
        .selectExpr(
            "cast(o_orderkey as string) as se10",
            "case when o_orderkey % 97 = 3 and k = 0 then null else k end as run_id",
            "case when o_orderkey % 97 = 3 and k = 0 then 'retry_final' else concat('run_', k) end as run_key",
            "case substr(o_orderpriority, 1, 1) when '1' then 'priority' when '2' then 'flex' "
            "when '3' then 'default' when '4' then null else 'standard' end as service_tier",
            "cast(floor(o_totalprice) as bigint) + k * 10 as input_tokens",
            "cast(floor(o_totalprice) as bigint) div 10 + k as output_tokens",
            "case when k > 0 then cast(floor(o_totalprice) as bigint) div 3 else 0 end as cache_read",
            "cast(floor(o_totalprice) as bigint) div 20 as reasoning",
        )
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a call; those past their order's runs belong to no run."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as string) as se10",
        "cast(l_linenumber % 5 as int) as run_id",
        "concat('run_', l_linenumber % 5) as run_key",
        "l_linenumber as call_index",
        "case l_returnflag when 'A' then 'search' when 'R' then 'open_page' else "
        "(case l_linestatus when 'O' then 'find_in_page' else 'screenshot' end) end as action_type",
        "case when l_quantity = 1 then 'failed' else 'completed' end as status",
        "case when l_returnflag = 'R' then case when l_quantity = 2 then '' else "
        "concat('https://www.Site', l_suppkey % 7, '.example/p', l_linenumber) end end as url",
        "l_partkey",
    )


def call_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query entries of the search calls: one billed, up to two more."""
    return (
        calls(spark, sf_dir)
        .filter("action_type = 'search'")
        .selectExpr(
            "se10", "run_id", "run_key", "call_index",
            "explode(sequence(0, cast(l_partkey % 3 as int))) as q_ord",
        )
        .withColumn("is_billed_query", F.col("q_ord") == 0)
    )


# Shared with the check SQL: pieces of answers as plain expressions on a line item.
ANSWER = (
    "case when l_quantity = 49 then null when cast(l_quantity as int) % 5 = 0 then 'NULL' "
    "when cast(l_quantity as int) % 5 = 1 then '3' when cast(l_quantity as int) % 5 = 2 then "
    "'3 - no adverse  media' when cast(l_quantity as int) % 5 = 3 then "
    "cast(cast(l_quantity as int) % 7 as {text}) else concat('Text ', cast(l_quantity as int) % 3) end"
)
EVIDENCE = (
    "case cast(round(l_tax * 100) as int) when 0 then null when 1 then '' when 2 then 'NULL' "
    "when 3 then ' null ' when 4 then 'see [a](b)' else concat('seen ([t](https://h', "
    "l_suppkey % 9, '.example))') end"
)
CE_ANSWER = (
    "case when l_discount < 0.025 then null when l_discount < 0.035 then 'null' "
    "when l_discount < 0.045 then '3' when l_discount < 0.085 then answer_text "
    "else upper(answer_text) || ' ' end"
)
CE_EVIDENCE = (
    "case cast(round(l_discount * 100) as int) % 4 when 0 then null when 1 then 'NULL' "
    "when 2 then ' ' else 'found' end"
)
PARSED_FROM = (
    "case when l_partkey % 9 = 0 then 'answer_dict' when l_partkey % 9 = 1 and "
    "l_returnflag = 'R' then 'answer_dict' when l_returnflag = 'N' and l_linestatus = 'O' then "
    "'citation_evidence' when l_returnflag = 'R' then 'answers_text_bare' "
    "when l_quantity = 50 then null else 'answers_text' end"
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is an answer: part = record, line number = run, supplier = question."""
    said, theirs = F.col("answer_text"), F.col("ce_answer")
    dict_said = F.expr(
        "case when l_quantity % 4 = 0 then null when l_quantity % 4 = 1 then 'NULL' "
        "else upper(answer_text) end"
    )
    prose = F.col("parsed_from").isin("answers_text", "answers_text_bare")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("answer_text", F.expr(ANSWER.format(text="string")))
        .withColumn("ce_answer", F.expr(CE_ANSWER))
        .withColumn("parsed_from", F.expr(PARSED_FROM))
        .select(
            F.expr("cast(l_partkey as string) as se10"),
            F.col("l_partkey").alias("output_id"),
            F.expr("case when l_linenumber = 7 then null else (l_linenumber - 1) % 4 end as run_id"),
            F.expr("case when l_linenumber = 7 then 'retry' else concat('run_', (l_linenumber - 1) % 4) end as run_key"),
            F.expr("cast(l_suppkey % 8 + 1 as int) as qnum"),
            F.col("l_orderkey").alias("ord"),
            "answer_text",
            F.expr(EVIDENCE).alias("evidence_text"),
            "ce_answer",
            F.expr(CE_EVIDENCE).alias("ce_evidence"),
            tx.is_null_word(said).alias("is_null"),
            "parsed_from",
            F.when(prose, tx.same_text(said) == tx.same_text(dict_said)).alias("agree_with_dict"),
            (tx.same_text(said) == tx.same_text(theirs)).alias("agree_with_ce"),
        )
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations on the same records, both sources, some without a URL."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "cast(l_partkey as string) as se10",
            "l_partkey as output_id",
            "case when l_linenumber = 7 then null else (l_linenumber - 1) % 4 end as run_id",
            "cast((l_suppkey + l_orderkey) % 8 + 1 as int) as qnum",
            "case when l_quantity < 15 then null when l_quantity < 18 then '' else "
            "concat('https://www.Site', l_suppkey % 7, '.example/p', l_linenumber) end as url",
            "case l_linestatus when 'F' then 'markdown_prose' else 'citation_evidence' end as source",
        )
        .withColumn("domain", tx.hostname(F.col("url")))
        .withColumn("empty_placeholder", F.coalesce(F.col("url"), F.lit("")) == "")
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an output record."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as se10",
        "p_partkey as output_id",
        "concat('output/part_', p_partkey % 5, '.jsonl') as src_file",
        "p_partkey as src_line",
        "concat('Answer about the shop: ', p_type, ' ', p_name, ' of ', p_brand) as question_user_prompt",
    )


# Shared with the check SQL: one order is searched for in six ways.
QUERY_TEXT = (
    "case k when 0 then concat('Customer#', lpad(cast(o_custkey as {text}), 9, '0'), ' reviews ', o_orderstatus) "
    "when 1 then concat('  \"CUSTOMER#', lpad(cast(o_custkey as {text}), 9, '0'), ' Building\"  opened ', o_orderpriority) "
    "when 2 then 'what is  this kind of shop?' "
    "when 3 then concat('complaints c', o_custkey, ' at shop', o_custkey % 7, '.example ', o_orderstatus) "
    "when 4 then concat('c', o_custkey, '@shop', o_custkey % 7, '.example and c', o_custkey, '@shop', o_custkey % 7, '.example') "
    "else concat('machinery or household near building ', o_orderstatus) end"
)


def entity_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries per customer, six per order, of which two are not billed."""
    return (
        spread_table(spark, sf_dir, "orders", EXPLODED_ROWS)
        .selectExpr("*", "explode(sequence(0, 5)) as k")
        .selectExpr(
            "cast(o_custkey as string) as se10",
            "o_orderkey as call_index",
            "k as q_ord",
            QUERY_TEXT.format(text="string") + " as query_text",
            "k < 4 as is_billed_query",
        )
    )


CITED_URL = (
    "case o_orderkey % 5 when 0 then null when 1 then 'https://other.example/x' "
    "else concat('https://www.Shop', o_custkey % 7, '.example/p') end"
)
CITED_QUESTION = (
    "case o_orderkey % 7 when 0 then 'Are there complaints about the shop?' when 1 then 'What kind of shop is it?' "
    "when 2 then 'Customer reviews near building' when 3 then null else 'zzz' end"
)


def entity_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation per order, of its customer; the fourth run made no query."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey as string) as se10", "o_orderkey % 4 as run_id", f"{CITED_URL} as url", f"{CITED_QUESTION} as question"
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a merchants row."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 17 <> 5").selectExpr(
        "cast(c_custkey as string) as se10", "c_name as name", "c_mktsegment as segment"
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data terms of customers; some customers have none."""
    packed = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.expr(e).alias("value_norm"))
                for f, e in [
                    ("name", "lower(c_name)"),
                    ("street", "concat(lower(c_name), ' building')"),
                    ("city", "lower(c_mktsegment)"),
                    ("email", "concat('c', c_custkey, '@shop', c_custkey % 7, '.example')"),
                    ("email", "concat('shop', c_custkey % 7, '.example')"),
                    ("owner", "concat('owner of c', c_custkey)"),
                ]
            ]
        )
    )
    return (
        spread_table(spark, sf_dir, "customer", EXPLODED_ROWS)
        .filter("c_custkey % 13 <> 7 and c_custkey % 17 <> 5")
        .select(F.expr("cast(c_custkey as string) as se10"), packed.alias("t"))
        .select("se10", "t.field", "t.value_norm")
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-kept groupings: one per order status, one that nothing has."""
    return (
        table(spark, sf_dir, "orders")
        .select(F.explode(F.array(F.concat(F.lit("<NAME> reviews "), F.lower("o_orderstatus")),
                                  F.concat(F.lit("no such query "), F.lower("o_orderstatus")))).alias("template"))
        .distinct()
        .withColumn("archetype", F.concat(F.lit("group "), F.right("template", F.lit(1))))
    )


QUERY_KEY = ["se10", "call_index", "q_ord"]
