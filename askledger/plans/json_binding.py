"""Log, entity and output lines made from the shared test tables, one line per row.

The lines carry every planted defect the parsers know. They use whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askledger.plans.binding import spread_table as table
from askledger.sources.lines import as_bronze

# Shared with the check SQL: the run key of an event's line.
RUN_KEY = (
    "case event_id % 50 when 7 then 'batch' when 9 then concat('retry_', event_id % 4) "
    "else concat('run_', event_id % 3) end"
)
ACTION = (
    "case event_type when 'click' then 'search' when 'purchase' then 'search' when 'view' then 'open_page' "
    "when 'signup' then 'find_in_page' else 'screenshot' end"
)


def weblog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event is one line: an entity (the user) with one run of up to three calls."""
    e = "event_id"
    text = f"""
    case {e} % 50
      when 0 then concat('{{"', user_id, '": {{"run_0": ')
      when 1 then '[1, 2]'
      when 2 then concat('{{"', user_id, '": 7}}')
      when 3 then concat('{{"', user_id, '": {{"run_1": "x"}}}}')
      when 8 then '   '
      else concat('{{"', user_id, '": {{"', {RUN_KEY}, '": {{',
        case when {e} % 50 = 5 then '' else concat('"usage_metadata": {{"service_tier": ',
          case when {e} % 3 = 0 then 'null' else concat('"', event_type, '"') end,
          ', "input_tokens": ', {e} + 100, ', "output_tokens": ', k, ', "total_tokens": ',
          {e} + 100 + k + case when {e} % 50 = 6 then 1 else 0 end,
          ', "cache_read": ', {e} % 10, ', "reasoning": ', k, '}}, ') end,
        '"web_search_calls": ', case when {e} % 50 = 4 then '"none"' else concat(
          '[{{"id": "c', {e}, case when {e} % 61 = 0 then '\\\\ufffd' else '' end, '"',
          case when {e} % 11 = 0 then ', "status": "failed"' when {e} % 13 = 0 then '' else ', "status": "completed"' end,
          ', "action_type": "', {ACTION}, '"',
          case when {e} % 7 = 0 then '' else concat(', "query": "Shop \\\\"', user_id, '\\\\" News"') end,
          case {e} % 5 when 0 then '' when 1 then concat(', "queries": ["Shop \\\\"', user_id, '\\\\" News", "more ', k, '", 7]')
            when 2 then concat(', "queries": ["shop  ', user_id, ', NEWS"]') when 3 then ', "queries": ["other"]'
            else ', "queries": "text"' end,
          case when {e} % 4 <> 0 and event_type = 'view' then concat(', "url": "https://Site', k, '.example/"') else '' end,
          '}}', case when {e} % 4 = 0 then ', 5' else '' end,
          case when {e} % 6 = 0 then ', {{"action_type": "search", "details": "d"}}' else '' end, ']') end,
        '}}}}}}') end"""
    rows = table(spark, sf_dir, "events").selectExpr(
        "*", "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k"
    ).selectExpr(
        "concat('logs/jsonl/f', event_id % 4, '.jsonl') as src_file", "event_id as src_line", f"{text} as value"
    )
    return as_bronze(rows, "weblog")


def input_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer is one entity record; some repeat another's key, some cannot be read."""
    c = "c_custkey"
    record = F.to_json(
        F.struct(
            F.expr(f"case when {c} % 40 = 0 then null when {c} % 40 = 3 then cast({c} + 1 as string) "
                   f"else cast({c} as string) end").alias("se10"),
            F.col("c_name").alias("se_toc_name"),
            F.expr("concat('  ', c_mktsegment, '. ')").alias("Seller_City_Name"),
            F.expr(f"case when {c} % 6 = 0 then null else concat('Info@Shop', {c} % 7, '.Example') end").alias(
                "Seller_Email_Address"
            ),
            F.expr(f"concat('+1 (555) ', {c})").alias("Business_Phone_No"),
            F.expr(f"concat('WWW.shop', {c} % 5, '.example')").alias("website"),
            F.expr("concat('NATION_', c_nationkey)").alias("state_name"),
            F.expr(f"case when {c} % 9 = 0 then 'Y' when {c} % 9 = 1 then '' end").alias("se_not_good_seller_ind"),
            F.expr(f"concat('reason ', {c})").alias("se_not_good_reason"),
            F.expr("array(c_nationkey)").alias("wwic_industry_tagged"),
        )
    )
    rows = table(spark, sf_dir, "customer").select(
        F.expr(f"concat('input/m', {c} % 3, '.jsonl')").alias("src_file"),
        F.col(c).alias("src_line"),
        F.when(F.expr(f"{c} % 40 = 1"), '{"se10": "broken')
        .when(F.expr(f"{c} % 40 = 2"), "[]")
        .otherwise(record)
        .alias("value"),
    )
    return as_bronze(rows, "input")


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document is one output record: its whole text is the evidence of two runs' answers."""

    def e(sql: str, name: str):
        return F.expr(sql).alias(name)

    link = "concat(' ([', source, '](https://', upper(source), '.example/', doc_id, '))')"
    run0 = (
        "concat('Q1. What is sold?\nA1. ', lang, '\nEvidence. ', text, "
        + link
        + ", ' ([]())', '\n\nQ2. How many?\nA2. ', n_chars)"
    )
    run1 = "concat('A1. NULL\nA2. 3\nEvidence: ', text)"
    prompt = (
        "case when doc_id % 37 = 0 then 'nothing asked' when doc_id % 10 = 4 then "
        "'Intro\nQ1. What is sold?\nQ5. Why?' else concat('Intro\nQ1. What is sold by ', source, '?\nQ2. How many?') end"
    )
    record = F.to_json(
        F.struct(
            e("case when doc_id % 50 = 49 then null when doc_id % 8 = 7 then cast(doc_id - 1 as string) "
              "else cast(doc_id as string) end", "se10"),
            e("case when doc_id % 5 = 0 then 3 else 2 end", "n_runs"),
            F.array(F.array(F.lit("You answer."), F.expr(prompt))).alias("questions"),
            F.when(F.expr("doc_id % 29 <> 5"), F.create_map(
                F.lit("run_0"), F.expr(run0), F.lit("run_1"), F.expr(run1)
            )).alias("answer"),
            F.struct(
                F.struct(
                    e("upper(lang)", "A1"),
                    e("case when doc_id % 2 = 0 then cast(n_chars as string) else 'many' end", "A2"),
                    e("source", "A3"),
                ).alias("run_0"),
                F.struct(e("array(lang, lang)", "A1"), e("array('3', cast(n_chars % 3 + 2 as string))", "A2")).alias(
                    "voted_majority"
                ),
                F.struct(e("case when doc_id % 3 = 0 then 'other' else lang end", "A1")).alias("voted_final"),
            ).alias("answer_dict"),
            F.struct(
                F.array(
                    F.struct(
                        F.lit("A1").alias("a_key"), e("lang", "answer"), e("text", "evidence"),
                        e("case when doc_id % 4 = 0 then null else concat('https://', upper(source), '.example/', doc_id) end",
                          "citation"),
                        F.lit("What is sold?").alias("question"),
                    ),
                    F.struct(
                        F.lit("A4").alias("a_key"), e("cast(doc_id as string)", "answer"),
                        e("cast(null as string)", "evidence"), e("cast(null as string)", "citation"),
                        F.lit("Else?").alias("question"),
                    ),
                ).alias("run_0"),
            ).alias("citation_evidence"),
            e("concat('www.shop', doc_id % 7, '.example')", "website"),
            e("concat('nation_', doc_id % 25)", "state"),
        )
    )
    rows = table(spark, sf_dir, "documents").select(
        F.expr("concat('output/o', doc_id % 3, '.jsonl')").alias("src_file"),
        F.col("doc_id").alias("src_line"),
        F.when(F.expr("doc_id % 50 = 48"), F.concat(F.lit('{"se10": "'), "source")).otherwise(record).alias("value"),
    )
    return as_bronze(rows, "output")
