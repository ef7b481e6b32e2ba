"""Check SQL of the parsing queries: it never sees the JSON, only the columns the lines are made from."""

from __future__ import annotations

from askledger.plans import json_binding as jb

B_LOGS = f"""
ev as (
  select event_id e, cast(user_id as varchar) u, cast(regexp_extract(props, '[0-9]+') as bigint) k, event_type t,
    event_id % 50 m, 'logs/jsonl/f' || (event_id % 4) || '.jsonl' src_file, event_id src_line,
    {jb.RUN_KEY} run_key, {jb.ACTION} act,
    case event_id % 50 when 7 then null when 9 then event_id % 4 else event_id % 3 end run_id
  from events
), good as (select * from ev where m not in (0, 1, 2, 3, 8)
), run_rows as (
  select u se10, run_id, run_key, case when m <> 5 and e % 3 <> 0 then t end service_tier,
    case when m <> 5 then e + 100 end input_tokens, case when m <> 5 then k end output_tokens,
    case when m <> 5 then e + 100 + k + (m = 6)::int end total_tokens, case when m <> 5 then e % 10 end cache_read,
    case when m <> 5 then k end reasoning, src_file, src_line,
    row_number() over (partition by u, run_key order by src_file, src_line) rn,
    count(*) over (partition by u, run_key) n_copies,
    first_value(src_file) over (partition by u, run_key order by src_file, src_line) first_file,
    first_value(src_line) over (partition by u, run_key order by src_file, src_line) first_line
  from good
), calls as (
  select src_file, src_line, u se10, run_key, run_id, 0 call_index,
    'c' || e || case when e % 61 = 0 then chr(65533) else '' end call_id, act action_type,
    case when e % 11 = 0 then 'failed' when e % 13 = 0 then null else 'completed' end status,
    case when e % 7 <> 0 then 'Shop "' || u || '" News' end query_raw,
    case e % 5 when 1 then ['Shop "' || u || '" News', 'more ' || k, '7'] when 2 then ['shop  ' || u || ', NEWS']
      when 3 then ['other'] end qs,
    case when e % 4 <> 0 and t = 'view' then 'https://Site' || k || '.example/' end url, null::varchar details,
    case when act = 'screenshot' or e % 5 = 4 or (act = 'search' and e % 7 = 0) or (act = 'open_page' and e % 4 = 0)
      then 'heuristic' else 'clean' end parse_conf,
    list_filter([
      case when act = 'screenshot' then 'UNKNOWN_ACTION_TYPE' end,
      case when e % 11 = 0 then 'CALL_STATUS_NOT_COMPLETED' end,
      case when e % 5 = 4 then 'QUERIES_NOT_A_LIST' end,
      case when e % 7 <> 0 and e % 5 = 2 then 'QUERY_REQUOTED' end,
      case when e % 7 <> 0 and e % 5 = 3 then 'QUERY_NOT_IN_QUERIES' end,
      case when act = 'search' and e % 7 = 0 then 'CALL_FIELD_MISSING' end,
      case when act = 'open_page' and e % 4 = 0 then 'CALL_FIELD_MISSING' end], lambda x: x is not null) codes
  from good where m <> 4
  union all
  select src_file, src_line, u, run_key, run_id, 1, null, '?', null, null, null, null, null, 'failed', ['CALL_NOT_AN_OBJECT']
  from good where m <> 4 and e % 4 = 0
  union all
  select src_file, src_line, u, run_key, run_id, 1 + (e % 4 = 0)::int, null, 'search', null, null, null, null, 'd',
    'heuristic', ['CALL_FIELD_MISSING']
  from good where m <> 4 and e % 6 = 0
), call_codes as (select *, unnest(codes) code from calls
), q as (
  select *, case when query_raw is null then [] else [query_raw] end
    || list_filter(coalesce(qs, []), lambda x: query_raw is null or x <> query_raw) entries from calls
), log_anomalies as (
  select 'ENCODING' code, null::varchar se10, src_file, src_line, true has_excerpt from good where m <> 4 and e % 61 = 0
  union all select 'BAD_JSON_LINE', null, src_file, src_line, true from ev where m = 0
  union all select 'WEBLOG_SHAPE_UNEXPECTED', null, src_file, src_line, true from ev where m = 1
  union all select 'WEBLOG_SHAPE_UNEXPECTED', u, src_file, src_line, false from ev where m in (2, 3, 4)
  union all select 'RUN_KEY_UNPARSED', u, src_file, src_line, true from ev where m = 7
  union all select 'MISSING_USAGE_METADATA', u, src_file, src_line, false from ev where m = 5
  union all select 'TOKEN_SUM_MISMATCH', u, src_file, src_line, false from ev where m = 6
  union all select 'DUP_RUN', se10, src_file, src_line, false from run_rows where rn > 1
  union all select code, se10, src_file, src_line, true from call_codes
)"""

B_INPUT = """
cust as (select c_custkey c, *, 'input/m' || (c_custkey % 3) || '.jsonl' src_file, c_custkey src_line, c_custkey % 40 m,
  case when c_custkey % 40 = 0 then null when c_custkey % 40 = 3 then cast(c_custkey + 1 as varchar)
    else cast(c_custkey as varchar) end se10 from customer
), cust_rows as (select *, row_number() over (partition by se10 order by src_file, src_line) rn
  from cust where m not in (1, 2) and se10 is not null
), kept as (select * from cust_rows where rn = 1
), in_terms as (
  select se10, 'name' field, lower(c_name) value_norm from kept
  union all select se10, 'city', lower(c_mktsegment) from kept
  union all select se10, 'phone', '+1 (555) ' || c from kept
  union all select se10, 'phone', '1555' || c from kept
  union all select se10, 'email', unnest(['info@shop' || (c % 7) || '.example', 'info', 'shop' || (c % 7) || '.example'])
    from kept where c % 6 <> 0
)"""

B_OUTPUT = """
doc as (
  select doc_id i, *, 'output/o' || (doc_id % 3) || '.jsonl' src_file, doc_id src_line,
    'output/o' || (doc_id % 3) || '.jsonl:' || doc_id output_id,
    cast(case when doc_id % 8 = 7 then doc_id - 1 else doc_id end as varchar) se10,
    doc_id % 29 <> 5 said, doc_id % 37 <> 0 asked, doc_id % 37 <> 0 and doc_id % 10 = 4 drifts,
    'https://' || upper(source) || '.example/' || doc_id url,
    case when doc_id % 37 = 0 then 'nothing asked' when doc_id % 10 = 4 then
      'Intro' || chr(10) || 'Q1. What is sold?' || chr(10) || 'Q5. Why?'
      else 'Intro' || chr(10) || 'Q1. What is sold by ' || source || '?' || chr(10) || 'Q2. How many?' end prompt
  from documents
), rec as (
  select *, row_number() over (partition by se10 order by src_file, src_line) rn, count(*) over (partition by se10) n_copies
  from doc where i % 50 not in (48, 49)
), seed as (select src_file sf, src_line sl, source from rec where asked order by src_file, src_line limit 1
), drift as (
  select r.*, case when drifts then '2' else '' end missing, case when drifts then '5' else '' end added,
    drifts or r.source <> s.source text_varies
  from rec r, seed s where asked and (src_file, src_line) > (sf, sl)
), ans as (
  select se10, output_id, 'run_0' run_key, 0 run_id, ord, qnum, answer_text, evidence_text,
    case qnum when 1 then lang when 4 then cast(i as varchar) end ce_answer, case qnum when 1 then text end ce_evidence,
    false is_null, parsed_from, agree_with_dict, case when qnum in (1, 4) then true end agree_with_ce
  from (
    select *, 0 ord, 1 qnum, lang answer_text,
      trim(text || ' ([' || source || '](' || url || ')) ([]())') evidence_text, 'answers_text' parsed_from, true agree_with_dict
      from rec where said
    union all select *, 1, 2, cast(n_chars as varchar), null, 'answers_text', i % 2 = 0 from rec where said
    union all select *, 0, 1, upper(lang), null, 'answer_dict', null from rec where not said
    union all select *, 1, 2, case when i % 2 = 0 then cast(n_chars as varchar) else 'many' end, null, 'answer_dict', null
      from rec where not said
    union all select *, 2, 3, source, null, 'answer_dict', null from rec
    union all select *, 3, 4, cast(i as varchar), null, 'citation_evidence', null from rec)
  union all
  select se10, output_id, 'run_1', 1, 0, 1, 'NULL', null, null, null, true, 'answers_text_bare', null, null from rec where said
  union all
  select se10, output_id, 'run_1', 1, 1, 2, '3', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), null, null, false,
    'answers_text_bare', null, null from rec where said
), cit as (
  select se10, output_id, url, source title, false empty_placeholder, 'markdown_prose' source, lower(source) || '.example' "domain",
    length('Q1. What is sold?' || chr(10) || 'A1. ' || lang || chr(10) || 'Evidence. ' || text) + 1 char_pos, 1 qnum from rec where said
  union all
  select se10, output_id, null, null, true, 'markdown_prose', null,
    length('Q1. What is sold?' || chr(10) || 'A1. ' || lang || chr(10) || 'Evidence. ' || text || ' ([' || source || '](' || url || '))') + 1,
    1 from rec where said
  union all
  select se10, output_id, case when i % 4 <> 0 then url end, 'What is sold?', i % 4 = 0, 'citation_evidence',
    case when i % 4 <> 0 then lower(source) || '.example' end, null, 1 from rec
  union all select se10, output_id, null, 'Else?', true, 'citation_evidence', null, null, 4 from rec
), vot as (
  select se10, output_id, 'A1' a_key, 1 qnum, lang voted_majority, case when i % 3 = 0 then 'other' else lang end voted_final,
    i % 3 = 0 differs from rec
  union all
  select se10, output_id, 'A2', 2, case when n_chars % 3 = 1 then '3' else '["3","' || (n_chars % 3 + 2) || '"]' end, null, false from rec
), short as (
  select src_file, src_line, 'run_0' run_key, 0 n_seen, 2 n_canonical, '1,2' missing
  from rec, seed where not said and (src_file, src_line) >= (sf, sl)
), clash as (
  select r.output_id, r.src_file, r.src_line, k.c is not null has_input, concat_ws('; ',
    case when 'www.shop' || (k.c % 5) <> 'www.shop' || (i % 7) then
      'website: input=WWW.shop' || (k.c % 5) || '.example output=www.shop' || (i % 7) || '.example' end,
    case when c_nationkey <> i % 25 then 'state: input=NATION_' || c_nationkey || ' output=nation_' || (i % 25) end) clashes
  from rec r left join kept k using (se10)
)"""


def _sql(*parts: str, select: str) -> str:
    return "with " + ", ".join(p.strip() for p in parts) + "\n" + select


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def logs(select):
        return _sql(B_LOGS, select=select)

    out["weblog_runs"] = logs("""
select * exclude (rn, n_copies, first_file, first_line) from run_rows where rn = 1""")
    out["weblog_duplicate_runs"] = logs("""
select se10, run_key, src_file, src_line, n_copies, first_file, first_line from run_rows where rn > 1""")
    out["weblog_calls"] = logs("""
select * exclude (qs, codes), array_to_string(qs, '|') queries, len(codes) n_notes from calls""")
    out["weblog_queries"] = logs("""
select se10, run_key, run_id, call_index, src_file, src_line, unnest(entries) query_text,
  unnest(range(0, len(entries))) q_ord, unnest(range(0, len(entries))) = 0 and query_raw is not null is_billed_query from q""")
    out["weblog_anomalies"] = logs("select code, se10, src_file, src_line from log_anomalies")
    out["anomaly_summary"] = logs("""
select code, 'weblogs' stage, count(*) n, count(distinct src_file) n_files from log_anomalies group by code""")
    out["anomaly_payload"] = logs("""
select code, src_file, count(*) n, count(*) filter (has_excerpt) n_excerpts from log_anomalies group by all""")
    out["anomaly_payload_of_three"] = logs("""
select code, src_file, count(*) n, count(*) filter (has_excerpt and rn <= 3) n_excerpts from (
  select *, row_number() over (partition by code, src_file order by src_line) rn from log_anomalies) group by code, src_file""")
    out["anomaly_samples"] = logs("""
select * from (select code, se10, src_file, src_line, row_number() over (partition by src_file order by src_line) rn
  from log_anomalies where code = 'QUERY_REQUOTED') order by rn, src_file, src_line limit 10""")
    out["reparsed_calls"] = logs("""
select action_type, parse_conf, count(*) n, coalesce(sum(len(qs)), 0)::bigint n_queries from calls group by all""")
    out["reparsed_anomalies"] = logs("select 'reparse' stage, code, count(*) n from call_codes group by code")

    def entities(select):
        return _sql(B_INPUT, select=select)

    out["input_merchants"] = entities("""
select se10, '  ' || c_mktsegment || '. ' city, case when c % 6 <> 0 then 'Info@Shop' || (c % 7) || '.Example' end email,
  '+1 (555) ' || c phone, 'WWW.shop' || (c % 5) || '.example' website, 'NATION_' || c_nationkey state,
  '[' || c_nationkey || ']' industry_tagged, null street, src_file, src_line from kept""")
    out["input_terms"] = entities("select * from in_terms")
    out["input_term_counts"] = entities("""
select (select count(*) from kept) n_entities, (select count(*) from in_terms) n_terms, 0 n_without_terms""")
    out["input_anomalies"] = entities("""
select 'BAD_JSON_LINE' code, null se10, src_file, src_line from cust where m = 1
union all select 'RECORD_NOT_AN_OBJECT', null, src_file, src_line from cust where m = 2
union all select 'MERCHANT_NO_SE10', null, src_file, src_line from cust where m = 0
union all select 'DUP_INPUT_SE10', se10, src_file, src_line from cust_rows where rn > 1""")
    columns = ("opening_date city industry_tagged sub_category email phone street signer_name owner_name owner_city "
               "owner_postal owner_street website country state").split()
    out["column_fill"] = entities(f"""
select column_name, case when column_name in ('city', 'industry_tagged', 'phone', 'website', 'state') then n
  when column_name = 'email' then ne else 0 end n_filled,
  column_name not in ('city', 'industry_tagged', 'phone', 'website', 'state', 'email') is_empty, n n_rows
from (select unnest({columns}) column_name), (select count(*) n, count(*) filter (c % 6 <> 0) ne from kept)""")
    wanted = ("se_toc_name sell_dba_nm sell_lgl_nm Seller_Street_Address Significant_Owner_Street_Address "
              "Authorized_Signer_Physical_Address Seller_City_Name Significant_Owner_City_Name Significant_Owner_Postal_Code "
              "sell_pstl_cd Business_Phone_No Seller_Email_Address Significant_Owner_Name Primary_Authorized_Signer_Name").split()
    out["schema_keys"] = entities(f"""
, head as (select * from kept),
found as (
  select unnest(['se10', 'se_toc_name', 'Seller_City_Name', 'Business_Phone_No', 'website', 'state_name',
    'se_not_good_reason', 'wwic_industry_tagged']) "key", (select count(*) from head) n
  union all select 'Seller_Email_Address', (select count(*) from head where c % 6 <> 0)
  union all select 'se_not_good_seller_ind', (select count(*) from head where c % 9 in (0, 1))
), wanted as (select unnest({wanted}) "key")
select "key", coalesce(n, 0) n_records, w."key" is not null is_wanted, coalesce(n, 0) > 0 is_present
from found full join wanted w using ("key")""")
    out["label_candidates"] = entities("""
select *, n_filled / nullif(n_records, 0) fill_share from (
select 'se_not_good_seller_ind' "key", count(*) n_records, count(*) filter (c % 9 in (0, 1)) > 0 is_present,
  count(*) filter (c % 9 = 0) n_filled, 1 n_distinct from kept
union all select 'se_not_good_reason', count(*), true, count(*), count(distinct c) from kept
union all select 'HRSE_tagged_merchant_ind', count(*), false, 0, 0 from kept)""")
    out["label_values"] = entities("""
select 'se_not_good_seller_ind' "key", 'Y' "value", count(*) n, 0 n_withheld from kept where c % 9 = 0
union all select 'se_not_good_reason', null, count(*), count(distinct c) from kept having count(distinct c) > 8""")
    out["customer_terms"] = """
select cast(c_custkey as varchar) se10, 'name' field, lower(c_name) value_norm from customer
union all select cast(c_custkey as varchar), 'city', lower(c_mktsegment) from customer"""

    def outputs(select, *first):
        return _sql(*first, B_OUTPUT, select=select)

    with_input = (B_INPUT,)
    out["output_records"] = outputs("""
select output_id, se10, case when i % 5 = 0 then 3 else 2 end n_runs, case when said then 2 else 0 end n_answer_runs,
  prompt question_user_prompt, n_copies > 1 dup_flag, false empty_voted_final from rec""", *with_input)
    out["output_questions"] = outputs("""
select 1 qnum, 'What is sold by ' || source || '?' text from seed union all select 2, 'How many?'""", *with_input)
    out["question_drift"] = outputs("select output_id, missing, added, text_varies from drift", *with_input)
    out["output_answers"] = outputs("select * from ans", *with_input)
    out["output_citations"] = outputs("select *, 'run_0' run_key, 0 run_id from cit", *with_input)
    out["output_votes"] = outputs("select * from vot", *with_input)
    out["short_runs"] = outputs("select * from short", *with_input)
    out["duplicate_records"] = outputs("""
select se10, src_file, src_line, n_copies, false identical from rec where rn > 1""", *with_input)
    out["field_conflicts"] = outputs("select output_id, has_input, clashes from clash", *with_input)
    out["fullest_records"] = outputs("""
select se10, output_id, n n_answer_runs from (select *, row_number() over (partition by se10 order by n desc, src_file desc, src_line desc) place
  from (select *, case when said then 2 else 0 end n from rec)) where place = 1""", *with_input)
    out["output_anomalies"] = outputs("""
, found as (
  select 'BAD_JSON_LINE' code, src_file, src_line from doc where i % 50 = 48
  union all select 'ENCODING', src_file, src_line from doc where i % 50 <> 48 and contains(text, chr(65533))
  union all select 'OUTPUT_NO_SE10', src_file, src_line from doc where i % 50 = 49
  union all select 'OUTPUT_NO_QUESTIONS', src_file, src_line from rec where not asked
  union all select 'OUTPUT_NO_ANSWERS', src_file, src_line from rec where not said
  union all select 'VOTE_VALUE_LIST', src_file, src_line from rec where n_chars % 3 <> 1
  union all select 'ANSWER_PARSE_MISMATCH', src_file, src_line from rec where said and i % 2 = 1
  union all select 'CITATION_SOURCE_MISMATCH', src_file, src_line from rec where said = (i % 4 = 0)
  union all select 'ANSWER_BLOCK_COUNT', src_file, src_line from short
  union all select 'QUESTION_SET_DRIFT', src_file, src_line from drift where drifts
  union all select 'DUP_OUTPUT_SE10', src_file, src_line from rec where rn > 1
  union all select 'INPUT_OUTPUT_FIELD_CONFLICT', src_file, src_line from clash where clashes <> '')
select code, count(*) n, count(distinct (src_file, src_line)) n_lines from found group by code""", *with_input)
    def cells(kind, **values):
        return " union all ".join(f"select '{kind}' kind, '{n}' \"name\", ({v}) \"value\"" for n, v in values.items())

    def in_rec(cond):
        return f"select count(*) from rec where {cond}"

    metrics = [
        cells("weblog", lines="select count(*) from ev", damaged_lines="select count(*) from good where m <> 4 and e % 61 = 0",
              entities="select count(*) from ev where m not in (0, 1, 2, 8)", runs="select count(*) from good",
              calls="select count(*) from calls"),
        "select 'weblog', 'action_' || action_type, count(*) from calls group by all",
        "select 'weblog', 'conf_' || parse_conf, count(*) from calls group by all",
        cells("input", lines="select count(*) from cust", damaged_lines="0", n_entities="select count(*) from kept",
              n_terms="select count(*) from in_terms", n_without_terms="0"),
        cells("output", lines="select count(*) from doc",
              damaged_lines="select count(*) from doc where i % 50 <> 48 and contains(text, chr(65533))",
              records=in_rec("true"), no_questions=in_rec("not asked"), no_answers=in_rec("not said"), no_votes="0",
              n_runs_mismatch=in_rec("i % 5 = 0 or not said"), empty_voted_final="0", votes="select count(*) from vot",
              votes_differ=in_rec("i % 3 = 0"), runs="select count(*) + count(*) filter (said) from rec",
              answer_blocks="select 4 * count(*) from rec where said", prose_citations=in_rec("said"),
              empty_placeholders=in_rec("said"), dict_citations="select 2 * count(*) from rec",
              citations_outside_blocks="0", citation_mismatches=in_rec("said = (i % 4 = 0)"),
              answer_disagreements=in_rec("said and i % 2 = 1"), bare_with_evidence=in_rec("said"),
              block_q_echo="select 2 * count(*) from rec where said", block_bare="select 2 * count(*) from rec where said",
              evidence_present="select 2 * count(*) from rec where said",
              evidence_absent="select 2 * count(*) from rec where said"),
        "select 'output', 'answers_from_' || parsed_from, count(*) from ans group by all",
    ]
    out["ingest_metrics"] = _sql(B_LOGS, B_INPUT, B_OUTPUT, select=" union all ".join(metrics))
    return out
