"""Check SQL: what each registered query must return, in a second engine's SQL."""

from __future__ import annotations

from askledger.plans import binding as b

B_RUNS = """
b_runs as (
  select cast(o_orderkey as varchar) se10,
    case when o_orderkey % 97 = 3 and k = 0 then null else k end run_id,
    case when o_orderkey % 97 = 3 and k = 0 then 'retry_final' else 'run_' || k end run_key,
    case o_orderpriority[1] when '1' then 'priority' when '2' then 'flex' when '3' then 'default'
      when '4' then null else 'standard' end service_tier,
    cast(floor(o_totalprice) as bigint) + k * 10 input_tokens,
    cast(floor(o_totalprice) as bigint) // 10 + k output_tokens,
    case when k > 0 then cast(floor(o_totalprice) as bigint) // 3 else 0 end cache_read,
    cast(floor(o_totalprice) as bigint) // 20 reasoning
  from (select *, unnest(range(0, o_orderkey % 4 + 1)) k from orders)
)"""
B_CALLS = """
b_calls as (
  select cast(l_orderkey as varchar) se10, l_linenumber % 5 run_id, 'run_' || (l_linenumber % 5) run_key,
    l_linenumber call_index, l_partkey,
    case l_returnflag when 'A' then 'search' when 'R' then 'open_page' else
      (case l_linestatus when 'O' then 'find_in_page' else 'screenshot' end) end action_type,
    case when l_quantity = 1 then 'failed' else 'completed' end status,
    case when l_returnflag = 'R' then case when l_quantity = 2 then '' else
      'https://www.Site' || (l_suppkey % 7) || '.example/p' || l_linenumber end end url
  from lineitem
), b_call_queries as (
  select se10, run_id, run_key, call_index, q_ord, q_ord = 0 is_billed_query
  from (select *, unnest(range(0, l_partkey % 3 + 1)) q_ord from b_calls where action_type = 'search')
)"""
B_ANSWERS = f"""
b_answers as (
  select *, lower(trim(answer_text)) = 'null' and answer_text is not null is_null,
    case when parsed_from in ('answers_text', 'answers_text_bare') then
      norm(answer_text) = norm(case when l_quantity % 4 = 0 then null when l_quantity % 4 = 1 then 'NULL'
        else upper(answer_text) end) end agree_with_dict,
    norm(answer_text) = norm(ce_answer) agree_with_ce,
    SHAPE(evidence_text) evidence_shape, SHAPE(ce_evidence) ce_evidence_shape
  from (select *, {b.CE_ANSWER} ce_answer from (
    select l_quantity, l_discount, cast(l_partkey as varchar) se10, l_partkey output_id,
      case when l_linenumber = 7 then null else (l_linenumber - 1) % 4 end run_id,
      case when l_linenumber = 7 then 'retry' else 'run_' || ((l_linenumber - 1) % 4) end run_key,
      l_suppkey % 8 + 1 qnum, l_orderkey ord, {b.ANSWER.format(text='varchar')} answer_text,
      {b.EVIDENCE} evidence_text, {b.CE_EVIDENCE} ce_evidence, {b.PARSED_FROM} parsed_from
    from lineitem))
)"""
B_CITATIONS = """
b_citations as (
  select cast(l_partkey as varchar) se10, l_partkey output_id,
    case when l_linenumber = 7 then null else (l_linenumber - 1) % 4 end run_id,
    (l_suppkey + l_orderkey) % 8 + 1 qnum,
    case when l_quantity < 15 then null when l_quantity < 18 then '' else
      'https://www.Site' || (l_suppkey % 7) || '.example/p' || l_linenumber end url,
    case l_linestatus when 'F' then 'markdown_prose' else 'citation_evidence' end source
  from lineitem
)"""
B_RECORDS = """
b_records as (
  select cast(p_partkey as varchar) se10, p_partkey output_id,
    'output/part_' || (p_partkey % 5) || '.jsonl' src_file, p_partkey src_line,
    'Answer about the shop: ' || p_type || ' ' || p_name || ' of ' || p_brand question_user_prompt
  from part
)"""
B_RATES = """
b_rates as (
  select * from (values ('standard', 2.5::double, 0.25::double, 15.0::double, 10.0::double),
    ('default', 2.5, 0.25, 15.0, 10.0), ('flex', null, null, null, null),
    ('priority', null, null, null, null)) t(tier, i, c, o, f)
)"""

B_MASK = f"""
b_terms as (
  select cast(c_custkey as varchar) se10, unnest([
    {{f: 'name', v: lower(c_name)}}, {{f: 'street', v: lower(c_name) || ' building'}},
    {{f: 'city', v: lower(c_mktsegment)}},
    {{f: 'email', v: 'c' || c_custkey || '@shop' || (c_custkey % 7) || '.example'}},
    {{f: 'email', v: 'shop' || (c_custkey % 7) || '.example'}},
    {{f: 'owner', v: 'owner of c' || c_custkey}}], recursive := true)
  from customer where c_custkey % 13 <> 7 and c_custkey % 17 <> 5
), b_sets as (
  select se10, list({{s: v, n: 0, f: f}} order by -length(v), v, f) terms from b_terms group by se10
), b_entity_queries as (
  select cast(o_custkey as varchar) se10, o_orderkey call_index, k q_ord,
    {b.QUERY_TEXT.format(text="varchar")} query_text, k < 4 is_billed_query
  from (select *, unnest(range(0, 6)) k from orders)
), b_groups as (
  select distinct unnest(['<NAME> reviews ' || lower(o_orderstatus), 'no such query ' || lower(o_orderstatus)]) template,
    'group ' || lower(o_orderstatus) archetype from orders
), m_one as (
  select q.*, t.terms is not null has_terms, list_reduce(coalesce(t.terms, []),
    lambda a, x: {{s: replace(a.s, x.s, '<' || upper(x.f) || '>'),
      n: a.n + (length(a.s) - length(replace(a.s, x.s, ''))) // length(x.s), f: ''}},
    {{s: lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'), ' .,;:!?"\'\'`()[]{{}}<>|')), n: 0, f: ''}}) m
  from b_entity_queries q left join b_sets t using (se10)
), masked as (
  select se10, call_index, q_ord, query_text, is_billed_query, has_terms, m.s template, m.n n_placeholders, archetype
  from m_one left join b_groups g on g.template = m.s
)"""
B_LEFT = """
l_words as (
  select distinct se10, f, w from (select se10, f, unnest(regexp_split_to_array(v, '[^0-9a-z]+')) w from b_terms)
  where length(w) >= 4
), l_rows as (
  select m.se10, m.call_index, m.q_ord, case when n_placeholders > 0 then 'masked' else 'unmasked' end kind,
    coalesce(list(distinct f) filter (contains(template, w)), []) fields
  from masked m join l_words using (se10) where is_billed_query group by all
)"""


def _expand(sql: str) -> str:
    """Spell out the two shorthands, norm(x) and SHAPE(x)."""
    import re

    def args(text: str, name: str, body) -> str:
        while (at := re.search(rf"\b{name}\(", text)) is not None:
            depth, i = 1, at.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                i += 1
            text = text[: at.start()] + body(text[at.end() : i - 1]) + text[i:]
        return text

    sql = args(sql, "SHAPE", lambda x: (
        f"(case when {x} is null then 'absent' when trim({x}) = '' then 'empty' "
        f"when upper(trim({x})) = 'NULL' then 'null' else 'present' end)"))
    return args(sql, "norm", lambda x: (
        f"replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss')"))


def _with(*parts: str, select: str) -> str:
    return _expand("with " + ", ".join(p.strip() for p in parts) + "\n" + select)


def _usage(by: str) -> str:
    return f"""
u_entries as (select se10, run_key, call_index, count(*) n from b_call_queries group by all),
u_sides as (
  select run_id, coalesce(service_tier, '<unset>') tier, 1 n_runs, input_tokens, cache_read, output_tokens,
    0 n_calls, 0 n_entries from b_runs
  union all
  select c.run_id, coalesce(r.service_tier, '<unset>'), 0, 0, 0, 0, 1, 0
    from b_calls c left join b_runs r using (se10, run_key)
  union all
  select q.run_id, coalesce(r.service_tier, '<unset>'), 0, 0, 0, 0, 0, 1
    from b_call_queries q left join b_runs r using (se10, run_key)
), u as (
  select {by}, sum(n_runs)::bigint n_runs, sum(input_tokens)::bigint input_tokens,
    sum(cache_read)::bigint cache_read, sum(output_tokens)::bigint output_tokens,
    sum(n_calls)::bigint n_calls, sum(n_entries)::bigint n_entries
  from u_sides group by all
), priced as (
  select u.*,
    (input_tokens - cache_read) * i / 1e6 + cache_read * c / 1e6 + output_tokens * o / 1e6
      + coalesce(n_calls * f / 1000, 0) cost,
    coalesce(n_calls * f / 1000, 0) fee
  from u left join b_rates r on r.tier = case when u.tier = '<unset>' then 'standard' else u.tier end
)"""


def _answer(source: str) -> str:
    return "coalesce(answer_text, ce_answer)" if source == "prose" else "coalesce(ce_answer, answer_text)"


def _card(source: str) -> str:
    ans = _answer(source)
    return f"""
s_cited as (select distinct output_id, run_id, qnum from b_citations where url <> '' and qnum is not null),
s_facts as (
  select a.*, trim({ans}) ans,
    evidence_shape = 'present' or ce_evidence_shape = 'present' has_ev,
    parsed_from = 'answers_text' or ce_answer is not null seen,
    c.qnum is not null has_cite,
    coalesce(lower(trim({ans})), '') = 'null' nul,
    regexp_matches(trim({ans}), '(?s)^[1-5]([^0-9].*)?$') scale,
    regexp_matches(trim({ans}), '(?s)^3([^0-9].*)?$') three
  from b_answers a left join s_cited c on c.output_id = a.output_id
    and c.run_id is not distinct from a.run_id and c.qnum = a.qnum
), s_multi as (
  select qnum, output_id, count(distinct coalesce(norm({ans}), '')) n
  from b_answers where run_id is not null group by all having count(distinct run_id) >= 2
), s_agree as (select qnum, count(*) filter (n = 1) n_runs_agree, count(*) n_runs_multi from s_multi group by qnum),
s_counts as (
  select qnum, count(*) n, count(*) filter (scale) n_scale, count(*) filter (not nul and not scale) n_text,
    count(*) filter (nul) n_null, count(*) filter (seen) n_ev_seen,
    count(*) filter (three and not has_ev and seen) n_default3,
    count(*) filter (nul or (three and not has_ev and seen)) n_noinfo,
    count(*) filter (not agree_with_dict) n_dict_differ, count(agree_with_dict) n_dict_comparable,
    count(*) filter (not agree_with_ce) n_ce_differ, count(agree_with_ce) n_ce_comparable,
    count(*) filter (has_cite) n_cited
  from s_facts group by qnum
), card as (
  select s.*, coalesce(n_runs_agree, 0) n_runs_agree, coalesce(n_runs_multi, 0) n_runs_multi,
    case when n_scale > 0 and n_text > 0 then 'mixed' when n_scale > 0 then 'scale'
      when n_text > 0 then 'text' else '-' end kind,
    n_null / nullif(n, 0) null_rate, n_default3 / nullif(n_ev_seen, 0) default3_rate,
    n_noinfo / nullif(n, 0) noinfo_rate, n_cited / nullif(n, 0) citation_rate,
    n_dict_differ / nullif(n_dict_comparable, 0) dict_differ_rate,
    n_ce_differ / nullif(n_ce_comparable, 0) ce_differ_rate,
    n_runs_agree / nullif(n_runs_multi, 0) agreement_rate
  from s_counts s left join s_agree using (qnum)
)"""


def _third(source: str = "prose") -> str:
    return f"""
t_ranked as (
  select output_id, qnum, coalesce(norm({_answer(source)}), '') a,
    row_number() over (partition by output_id, qnum order by run_id, ord, coalesce(norm({_answer(source)}), '')) rn
  from b_answers where run_id is not null
), t_trio as (
  select output_id, qnum, count(*) n, max(a) filter (rn = 1) a0, max(a) filter (rn = 2) a1, max(a) filter (rn = 3) a2
  from t_ranked group by all
), t_counts as (
  select qnum, count(*) filter (n >= 3) n_three, count(*) filter (n >= 3 and a0 = a1) n_redundant,
    count(*) filter (n >= 3 and a0 <> a1 and (a2 = a0 or a2 = a1)) n_decisive,
    count(*) filter (n >= 3 and a0 <> a1 and a2 <> a0 and a2 <> a1) n_no_majority,
    count(*) filter (n = 2) n_pairs, count(*) filter (n = 2 and a0 = a1) n_pairs_agree
  from t_trio group by qnum
), third as (
  select *, n_redundant / nullif(n_three, 0) redundant_rate, n_decisive / nullif(n_three, 0) decisive_rate,
    n_no_majority / nullif(n_three, 0) no_majority_rate, n_pairs_agree / nullif(n_pairs, 0) pair_agreement
  from t_counts
)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    # --- scorecard
    for name, source in (("scorecard", "prose"), ("scorecard_ce", "ce")):
        out[name] = _with(B_ANSWERS, B_CITATIONS, _card(source), select="select * from card")
    out["drop_candidates"] = _with(
        B_ANSWERS, B_CITATIONS, _card("prose"),
        select="select * from card order by coalesce(noinfo_rate, 0) desc, qnum limit 10")
    out["null_rate_by_source"] = _with(B_ANSWERS, select="""
select source, count(*) filter (coalesce(lower(trim(a)), '') = 'null') n_null, count(a) n,
  count(*) filter (coalesce(lower(trim(a)), '') = 'null') / nullif(count(a), 0) null_rate
from (select 'prose' source, answer_text a from b_answers union all
  select 'citation_evidence', ce_answer from b_answers) group by source""")
    out["parsed_from_counts"] = _with(B_ANSWERS, select="""
select coalesce(parsed_from, '<unset>') parsed_from, count(*) n from b_answers group by 1""")
    out["blind_answers"] = _with(B_ANSWERS, B_CITATIONS, _card("prose"), select="""
select sum(n)::bigint n_answers, sum(n_ev_seen)::bigint n_ev_seen, sum(n - n_ev_seen)::bigint n_blind from card""")
    out["subqueries_per_run"] = _with(B_RUNS, B_CALLS, B_ANSWERS, select="""
, per_run as (select r.se10, r.run_key, count(q.se10) q from b_runs r
  left join b_call_queries q on q.se10 = r.se10 and q.run_key = r.run_key group by all)
select n_log_runs, n_output_runs, n_queries, n_exact, n_within_2, n_queries / nullif(n_log_runs, 0) per_run,
  n_log_runs = n_output_runs same_population
from (select count(*) n_log_runs, (select count(*) from (select distinct output_id, run_id from b_answers
    where run_id is not null)) n_output_runs,
  sum(q)::bigint n_queries, count(*) filter (q = 3) n_exact, count(*) filter (abs(q - 3) <= 2) n_within_2 from per_run)""")
    # --- usage and cost
    tier = _usage("tier")
    both = _usage("run_id, tier")
    usage = (B_RUNS, B_CALLS, B_RATES)
    out["usage_by_tier"] = _with(*usage, tier, select="select * from priced")
    out["usage_by_run"] = _with(*usage, both, select="select * from priced")
    out["total_cost"] = _with(*usage, tier, select="""
select round(coalesce(sum(cost), 0), 6) total, bool_or(cost is null) excludes_unpriced,
  bool_or(tier = '<unset>') unset_at_standard from priced""")
    slices = """
slices as (
  select run_id, sum(n_runs)::bigint n_runs, sum(n_calls)::bigint n_calls, sum(input_tokens)::bigint input_tokens,
    sum(cache_read)::bigint cache_read, sum(output_tokens)::bigint output_tokens,
    case when count(*) filter (cost is null) = 0 then sum(cost) end cost, sum(fee) fee,
    sum(cache_read)::bigint / nullif(sum(input_tokens)::bigint, 0) hit_rate
  from priced group by run_id
)"""
    out["run_slices"] = _with(*usage, both, slices, select="select * replace (round(cost, 6) as cost, round(fee, 6) as fee) from slices")
    out["unpriced_tiers"] = _with(*usage, both, select="select distinct tier from priced where cost is null")
    out["cut_to_two_runs"] = _with(*usage, both, slices, select="""
select cut_runs, cut_calls, n_runs, round(cut_cost, 6) cut_cost, round(cut_fee, 6) cut_fee,
  round(total_cost, 6) total_cost, cut_runs / nullif(n_runs, 0) cut_runs_share,
  round(cut_cost / nullif(total_cost, 0), 9) cut_cost_share
from (select coalesce(sum(n_runs) filter (run_id >= 2), 0)::bigint cut_runs,
  coalesce(sum(n_calls) filter (run_id >= 2), 0)::bigint cut_calls, sum(n_runs)::bigint n_runs,
  case when count(*) filter (run_id >= 2) > 0 and count(*) filter (run_id >= 2 and cost is null) = 0
    then sum(cost) filter (run_id >= 2) end cut_cost,
  sum(fee) filter (run_id >= 2) cut_fee,
  case when count(*) filter (cost is null) = 0 then sum(cost) end total_cost from slices)""")
    out["run_count_distribution"] = _with(B_RUNS, select="""
select n_runs, count(*) n_entities from (select se10, count(*) n_runs from b_runs group by 1) group by 1""")
    out["cache_by_run"] = _with(B_RUNS, select="""
select case when grouping(run_id) = 1 then 'total' else 'run' end scope, run_id, count(*) n_runs,
  sum(input_tokens)::bigint input_tokens, sum(cache_read)::bigint cache_read,
  coalesce(sum(cache_read)::bigint / nullif(sum(input_tokens)::bigint, 0), 0) hit_rate
from b_runs group by rollup (run_id)""")
    prefix = """
select {by} n_prompts, prefix_chars, avg_prompt_chars, prefix_chars // 4 prefix_tokens, prefix_chars // 4 >= 1024 reaches_floor
from (select {by} count(*) n_prompts, sum(length({c}))::bigint // count(*) avg_prompt_chars, min({c}) lo, max({c}) hi,
  coalesce(nullif(list_position(list_transform(range(1, length(min({c})) + 2),
    lambda i: substr(min({c}), i, 1) <> substr(max({c}), i, 1) or i > length(min({c}))), true), 0) - 1,
    length(min({c})))::bigint prefix_chars
  from {t} where {c} <> '' {g})"""
    out["shared_prefix"] = _with(B_RECORDS, select=prefix.format(by="", c="question_user_prompt", t="b_records", g=""))
    out["shared_prefix_by_source"] = _expand(prefix.format(by="source,", c="text", t="documents", g="group by source"))
    out["url_overlap"] = _with(B_CALLS, B_CITATIONS, select="""
, cited as (select distinct se10, url from b_citations where url <> ''),
opened as (select distinct se10, url from b_calls where action_type = 'open_page' and url <> ''),
n as (select (select count(*) from cited) cited_urls, (select count(*) from opened) opened_urls,
  (select count(*) from cited join opened using (se10, url)) n_both)
select *, coalesce(n_both / nullif(cited_urls, 0), 0) covered, coalesce(n_both / nullif(cited_urls, 0), 0) >= 0.8 mostly_opened from n""")
    out["token_summary"] = _with(B_RUNS, select="""
select count(*) n_runs, sum(input_tokens)::bigint input_tokens, sum(cache_read)::bigint cache_read,
  sum(output_tokens)::bigint output_tokens, sum(reasoning)::bigint reasoning,
  sum(cache_read)::bigint / nullif(sum(input_tokens)::bigint, 0) hit_rate,
  sum(reasoning)::bigint / nullif(sum(output_tokens)::bigint, 0) reasoning_share from b_runs""")
    out["tier_mix"] = _with(B_RUNS, select="""
select coalesce(service_tier, '<unset>') tier, count(*) n from b_runs group by 1""")
    # --- further reads
    said = _answer("prose")
    out["answer_spread"] = _with(B_ANSWERS, select=f"""
select qnum, count(*) n_records, round(avg(most / n), 6) majority_share,
  round(avg(greatest(log2(n) - clogc / n, 0)), 6) entropy, count(*) filter (most * 2 > n) n_majority
from (select qnum, output_id, sum(c) n, max(c) most, sum(c * log2(c)) clogc from (
    select qnum, output_id, norm(coalesce({said}, '')) said, count(*) c from b_answers where run_id is not null group by all)
  group by all) group by qnum""")
    out["calls_by_position"] = _with(B_CALLS, B_CITATIONS, select="""
, cited as (select distinct se10, url from b_citations where url <> '')
select *, n_cited / nullif(n_opened, 0) cited_share from (
  select call_index, count(*) n_calls, count(*) filter (action_type = 'search') n_search,
    count(*) filter (action_type = 'open_page') n_open_page, count(*) filter (action_type = 'find_in_page') n_find_in_page,
    count(*) filter (action_type = 'open_page' and b_calls.url <> '') n_opened,
    count(*) filter (action_type = 'open_page' and cited.url is not null) n_cited
  from b_calls left join cited using (se10, url) group by call_index)""")
    out["calls_per_entity"] = _with(B_CALLS, select="""
select count(*) n_entities, sum(n)::bigint n_calls, quantile_cont(n, 0.5) median_calls, quantile_cont(n, 0.9) p90_calls,
  max(n) most_calls from (select count(*) n from b_calls group by se10)""")
    capped = B_CALLS.replace("from lineitem", "from lineitem where l_linenumber <= 2", 1)
    out["usage_capped_at_two"] = _with(B_RUNS, capped, B_RATES, tier, select="select * from priced")
    # every citation against every query of its entity
    out["citation_queries"] = _with(f"""
q as (
  select *, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+')) w,
    list_transform(regexp_extract_all(lower(query_text), '[a-z0-9-]+(?:\\.[a-z0-9-]+)+'), lambda x: regexp_replace(x, '^www\\.', '')) h
  from (select distinct cast(o_custkey as varchar) se10, o_orderkey % 3 query_run, {b.QUERY_TEXT.format(text="varchar")} query_text
    from (select *, unnest(range(0, 6)) k from orders))
), c as (
  select se10, run_id, domain, question, count(*) n_citations,
    coalesce(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), []) w
  from (select cast(o_custkey as varchar) se10, o_orderkey % 4 run_id, {b.CITED_QUESTION} question,
    lower(nullif(regexp_extract({b.CITED_URL}, 'https://([^/]+)', 1), '')) as domain from orders) group by all
), p as (
  select c.*, query_text, query_run, len(list_intersect(c.w, q.w)) shared,
    coalesce(list_contains(h, regexp_replace(domain, '^www\\.', '')), false) has_host
  from c left join q using (se10)
), r as (
  select *, case when has_host or shared > 0 then has_host::int * 100 + coalesce(60 * shared // nullif(len(w), 0), 0)
    + (run_id = query_run)::int * 20 end score from p
), n as (
  select *, row_number() over (partition by se10, run_id, domain, question order by score desc nulls last, query_text, query_run) rn from r)""", select="""
select se10, run_id, domain, question, max(n_citations) n_citations, max(query_text) filter (rn = 1 and score is not null) query_text,
  max(query_run) filter (rn = 1 and score is not null) query_run, max(score) filter (rn = 1)::bigint score,
  max(score) filter (rn = 2)::bigint runner_up,
  coalesce(max(score) filter (rn = 1) - max(score) filter (rn = 2) <= 10, false) is_ambiguous
from n group by se10, run_id, domain, question""")
    out["label_value"] = _with(B_ANSWERS, select=f"""
select *, null_rate - said_rate gap from (
  select *, n_null_labelled / nullif(n_null, 0) null_rate, n_said_labelled / nullif(n_said, 0) said_rate from (
    select qnum, count(*) filter (nul) n_null, count(*) filter (nul and label = 1) n_null_labelled,
      count(*) filter (not nul) n_said, count(*) filter (not nul and label = 1) n_said_labelled
    from (select qnum, lower(trim(coalesce({said}, ''))) = 'null' nul, p_size % 2 label
      from b_answers join part on se10 = cast(p_partkey as varchar)) group by qnum))""")
    # --- third run
    for name, source in (("third_run", "prose"), ("third_run_ce", "ce")):
        out[name] = _with(B_ANSWERS, _third(source), select="select * from third")
    out["least_conclusive"] = _with(B_ANSWERS, _third(), select="""
select * from third order by coalesce(no_majority_rate, 0) desc, qnum limit 10""")
    out["third_run_totals"] = _with(B_ANSWERS, B_RUNS, _third(), select="""
, s as (select sum(n_three)::bigint n_three, sum(n_redundant)::bigint n_redundant, sum(n_decisive)::bigint n_decisive,
  sum(n_no_majority)::bigint n_no_majority, sum(n_pairs)::bigint n_pairs, sum(n_pairs_agree)::bigint n_pairs_agree,
  max(n_three) n_records, count(*) n_questions,
  (select count(*) from (select se10 from b_runs group by 1 having count(*) >= 3)) n_log_three from third)
select *, n_three = n_records * n_questions uniform, abs(n_records - n_log_three) population_gap,
  n_redundant / nullif(n_three, 0) redundant_rate, n_decisive / nullif(n_three, 0) decisive_rate,
  n_no_majority / nullif(n_three, 0) no_majority_rate, n_pairs_agree / nullif(n_pairs, 0) pair_agreement from s""")
    # --- masking
    def masking(select, *more):
        return _with(B_MASK, *more, select=select)

    out["mask_queries"] = masking(
        "select se10, call_index, q_ord, template, n_placeholders, archetype, has_terms from masked")
    out["unmatched_groups"] = masking("""
select template, archetype from b_groups where template not in (select template from masked)""")
    out["unmaskable"] = masking("""
select se10, count(*) n_rows, cast(se10 as bigint) % 17 <> 5 has_merchant from masked where not has_terms group by se10""")
    out["masking_anomalies"] = masking("""
select 'analyze' stage, 'ARCHETYPE_GROUP_UNMATCHED' code, null se10 from b_groups
  where template not in (select template from masked)
union all select distinct 'analyze', 'TEMPLATE_NO_PII_TERMS', se10 from masked where not has_terms""")
    out["mask_counters"] = masking("""
select count(*) tmpl_rows, count(*) filter (n_placeholders > 0) tmpl_masked,
  count(*) filter (n_placeholders = 0) tmpl_unmasked,
  count(distinct se10) filter (not has_terms) tmpl_no_terms_entities,
  count(*) filter (not has_terms) tmpl_no_terms_rows,
  (select count(*) from b_groups) tmpl_group_rows,
  (select count(*) from b_groups where template not in (select template from masked)) tmpl_group_unmatched from masked""")
    out["archetype_rollup"] = masking("""
select coalesce(archetype, template) archetype_id, min(query_text) exemplar, count(*) n_queries,
  count(distinct se10) n_merchants, count(*) filter (is_billed_query) n_billed_calls,
  bool_or(archetype is null) is_unmapped from masked group by 1""")
    out["masking_totals"] = masking("""
select *, n_unmasked_billed / nullif(n_billed, 0) unmasked_share, n_mapped_billed / nullif(n_billed, 0) mapped_share
from (select count(*) n_rows, count(template) n_templated, count(*) filter (is_billed_query) n_billed,
  count(*) filter (n_placeholders = 0) n_unmasked,
  count(*) filter (n_placeholders = 0 and is_billed_query) n_unmasked_billed,
  count(*) filter (archetype is not null and is_billed_query) n_mapped_billed,
  count(distinct archetype) n_groups from masked)""")
    out["head_coverage"] = masking("""
, t as (select template, count(*) n from masked where is_billed_query group by 1)
select *, least(100, n_distinct) head_size, head_covered / nullif(n_billed, 0) head_coverage,
  n_distinct <= 100 head_is_whole, coalesce(head_covered / nullif(n_billed, 0) < 0.5, false) thin_head
from (select sum(n)::bigint n_billed, count(*) n_distinct, count(*) filter (n = 1) n_singleton,
  (select sum(n)::bigint from (select n from t order by n desc limit 100)) head_covered from t)""")
    # pairs that share one of their rarest grams, compared on all grams; then everything reachable
    out["merged_templates"] = masking("""
, t as (select template, count(*) n from masked where template is not null and is_billed_query group by 1)
, g as materialized (select template, unnest(case when length(low) < 3 then [low] else list_distinct(
    flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, length(low) - k + 2), lambda i: substr(low, i, k))))) end) gram
  from (select template, lower(template) low from t))
, o as materialized (select template, list(gram order by df, gram) s
  from g join (select gram, count(*) df from g group by 1) using (gram) group by 1)
, k as materialized (select template, unnest(s[1:len(s) - (85 * len(s) + 99) // 100 + 1]) gram from o)
, p as materialized (select a, b from (
    select a, b, len(list_intersect(x.s, y.s)) shared, len(x.s) + len(y.s) total
    from (select distinct l.template a, r.template b from k l join k r on l.gram = r.gram and l.template < r.template)
    join o x on x.template = a join o y on y.template = b)
  where 100 * shared >= 85 * (total - shared))
, e as materialized (select a, b from p union all select b, a from p)
, c as (with recursive r as (select template a, template b from t union select r.a, e.b from r join e on r.b = e.a) select * from r)
select template, n, coalesce(n_similar, 0) n_similar, merged from t
  join (select a template, first(b order by n desc, b) merged from c join t on t.template = c.b group by a) using (template)
  left join (select a template, count(*) n_similar from e group by a) using (template)""")
    out["merged_counts"] = f"""
select merged, count(*) n_templates, sum(n)::bigint n_queries, max(n) n_largest from ({out['merged_templates']}) group by 1 having count(*) > 1"""
    out["placeholder_counts"] = masking("""
select f field, count(*) filter (is_billed_query and contains(template, '<' || upper(f) || '>')) n
from masked, (select unnest(['name', 'street', 'city', 'zip', 'phone', 'email', 'owner']) f) group by f""")
    out["template_collapse"] = masking("""
select case when n_placeholders = 0 then 'unmasked' else 'masked' end kind, count(*) n_queries,
  count(distinct template) n_templates, count(*) / count(distinct template) per_template
from masked where is_billed_query group by 1""")
    out["leftover_words"] = masking("""
select kind, count(*) n, count(*) filter (len(fields) > 0) n_hit, count(*) filter (len(fields) > 0) / count(*) hit_rate
from l_rows group by kind""", B_LEFT)
    out["leftover_by_field"] = masking("""
select kind, field, count(*) n from (select kind, unnest(fields) field from l_rows) group by all""", B_LEFT)
    head = """
select template, count(*) n_billed_calls, count(distinct se10) n_merchants, max(archetype) archetype
from masked where is_billed_query {gate} group by 1 order by 2 desc, 1 limit 200"""
    out["head_templates"] = masking(head.format(gate="and n_placeholders > 0"))
    out["head_templates_all"] = masking(head.format(gate=""))
    out["withheld_templates"] = masking("""
select count(distinct template) n_withheld from masked where is_billed_query and n_placeholders = 0""")
    # --- health and defects
    defects = """
d_runs as (select output_id, run_id, count(*) n_answers, count(*) filter (parsed_from = 'answer_dict') n_dict
  from b_answers where run_id is not null group by all),
d as (select r.se10, r.src_file, r.src_line, p.output_id, p.run_id, n_dict, n_answers, n_dict = n_answers total_fail,
  n_dict > 0 any_dict, exists (select 1 from b_runs l where l.se10 = r.se10 and l.run_id = p.run_id) has_log
  from d_runs p join b_records r using (output_id)),
defects as (select *, case when not total_fail and not any_dict and has_log then 'ok' else concat_ws('+',
  case when total_fail then 'prose_unreadable' when any_dict then 'prose_partial' end,
  case when not has_log then 'output_only' end) end defect from d)"""

    def broken(select):
        return _with(B_ANSWERS, B_RECORDS, B_RUNS, defects, select=select)

    out["run_defects"] = broken("select * from defects")
    out["defect_crosstab"] = broken("""
select state, count(*) filter (x.s = state and has_log) in_logs, count(*) filter (x.s = state and not has_log) output_only
from (select unnest(['prose ok', 'prose partial', 'prose UNREADABLE']) state),
  (select *, case when total_fail then 'prose UNREADABLE' when any_dict then 'prose partial' else 'prose ok' end s from defects) x
group by state""")
    out["defect_overlap"] = broken("""
select *, case when overlap > 0.9 then 'same' when overlap < 0.1 then 'independent' when overlap is not null then 'partial' end verdict
from (select *, n_both / nullif(least(n_unreadable, n_output_only), 0) overlap from (
  select count(*) n_runs, count(*) filter (total_fail) n_unreadable, count(*) filter (not has_log) n_output_only,
    count(*) filter (total_fail and not has_log) n_both from defects))""")
    out["defect_files"] = broken("""
select src_file, count(*) n_defective from defects where any_dict or not has_log group by 1""")
    out["defect_pointers"] = broken("""
select * from (select 'prose_unreadable' kind, src_file, src_line from defects where total_fail
  order by has_log, src_file, src_line, run_id limit 1)
union all select * from (select 'output_only', src_file, src_line from defects where not has_log
  order by total_fail desc, src_file, src_line, run_id limit 1)""")
    out["defect_export_output_only"] = broken("select * from defects where not has_log")
    out["corpus_counts"] = _with(B_RUNS, B_RECORDS, B_MASK, select="""
select (select count(*) from customer where c_custkey % 17 <> 5) merchants_input,
  (select count(distinct se10) from b_runs) merchants_logs, (select count(distinct se10) from b_records) merchants_outputs,
  (select count(*) from b_runs) n_runs, (select count(*) from b_records) n_records, (select count(*) from b_terms) n_terms""")
    out["reconcile_runs"] = _with(B_ANSWERS, B_RECORDS, B_RUNS, select="""
, l as (select distinct se10, run_id from b_runs where run_id is not null),
o as (select distinct r.se10, a.run_id from b_answers a join b_records r using (output_id) where a.run_id is not null)
select (select count(*) from l) n_log, (select count(*) from o) n_out,
  (select count(*) from (from o except from l)) output_only, (select count(*) from (from l except from o)) log_only,
  (select count(*) from b_runs where run_id is null) n_unparsed""")
    out["terms_by_field"] = masking("select f field, count(*) n from b_terms group by f")

    def answers(select):
        return _with(B_ANSWERS, select=select)

    out["unreadable_runs"] = answers("""
select count(*) n_runs, count(*) filter (d = n) n_all_dict, count(*) filter (d > 0 and d < n) n_part_dict
from (select count(*) n, count(*) filter (parsed_from = 'answer_dict') d from b_answers
  where run_id is not null group by output_id, run_id)""")
    out["agreement_tallies"] = answers("""
select other, count(*) filter (a) n_agree, count(*) filter (not a) n_differ, count(*) filter (a is null) n_not_comparable,
  count(*) filter (not a) / nullif(count(a), 0) differ_rate
from (select 'answer_dict' other, agree_with_dict a from b_answers
  union all select 'citation_evidence', agree_with_ce from b_answers) group by other""")
    out["answer_sources"] = answers("""
select *, n_ce_answers / nullif(n_answers, 0) ce_share, n_ce_answers / nullif(n_runs, 0) ce_per_run from (
select count(*) n_answers, count(ce_answer) n_ce_answers,
  (select count(*) from (select 1 from b_answers group by output_id, run_id)) n_runs,
  (select count(*) from (select 1 from b_answers group by output_id, run_id having count(ce_answer) = 8)) n_runs_full,
  (select count(*) from (select 1 from b_answers group by output_id, run_id having count(ce_answer) = 0)) n_runs_none,
  count(*) filter (evidence_shape <> 'present' and ce_evidence_shape = 'present') n_evidence_repaired,
  count(*) filter (parsed_from = 'answer_dict') n_from_dict,
  count(*) filter (parsed_from = 'answer_dict' and agree_with_ce) n_dict_agree,
  count(*) filter (parsed_from = 'answer_dict' and not agree_with_ce) n_dict_differ from b_answers)""")
    out["evidence_links"] = answers("""
select count(*) n_any_link, count(*) filter (evidence_text like '%([%](%') n_wrapped,
  count(*) filter (evidence_text not like '%([%](%') n_bare from b_answers where evidence_text like '%](%'""")
    out["answer_totals"] = answers("select count(*) n_answers, count(*) filter (is_null) n_null from b_answers")
    out["query_totals"] = masking("""
select count(*) n_queries, count(*) filter (is_billed_query) n_billed, count(*) filter (not is_billed_query) n_sub_queries
from b_entity_queries""")
    out["call_breakdowns"] = _with(B_CALLS, select="""
select 'calls' section, 'action_type' metric, action_type "key", count(*)::double "value" from b_calls group by 3
union all select 'calls', 'status', status, count(*)::double from b_calls group by 3""")
    out["answer_breakdowns"] = answers(" union all ".join(
        f"select 'answers' section, '{c}' metric, {c} \"key\", count(*)::double \"value\" from b_answers group by 3"
        for c in ("parsed_from", "evidence_shape", "ce_evidence_shape")))
    out["citation_breakdowns"] = _with(B_CITATIONS, select="""
select 'citations' section, 'source' metric, source "key", count(*)::double "value" from b_citations group by 3
union all select 'citations', 'empty_placeholder', case when coalesce(url, '') = '' then 'true' else 'false' end,
  count(*)::double from b_citations group by 3""")
    out["citation_domains"] = _with(B_CITATIONS, select="""
select lower(nullif(regexp_extract(url, '^https?://([^/:]+)', 1), '')) as domain, count(*) n from b_citations group by 1""")
    return out
