import pytest
from support import rows
from pyspark.sql import functions as F

from askledger.operators import defects, health, masking, runs, scorecard, usage

RATES = {
    "standard": {"input_per_mtok": 2.5, "cached_input_per_mtok": 0.25, "output_per_mtok": 15.0, "fee_per_1k_search_calls": 10.0},
    "flex": {},
}
RUNS = "se10 string, run_key string, run_id int, service_tier string, input_tokens bigint, cache_read bigint, output_tokens bigint, reasoning bigint"
CALLS = "se10 string, run_key string, run_id int, action_type string, url string"
ANSWERS = (
    "se10 string, output_id bigint, run_id int, qnum int, ord int, answer_text string, evidence_text string, ce_answer string, "
    "ce_evidence string, is_null boolean, parsed_from string, agree_with_dict boolean, agree_with_ce boolean"
)
CITATIONS = "se10 string, output_id bigint, run_id int, qnum int, url string"


def answer(out, run, q, text, ce=None, evidence=None, source="answers_text"):
    return (str(out), out, run, q, 0, text, evidence, ce, None, text == "NULL", source, None, None)


def test_cost_arithmetic(spark):
    r = spark.createDataFrame([("1", "run_0", 0, None, 2_000_000, 1_000_000, 1_000_000, 5)], RUNS)
    c = spark.createDataFrame([("1", "run_0", 0, "open_page", None)] * 1000, CALLS)
    q = c.select("se10", "run_key", "run_id").limit(300)
    priced = usage.with_cost(usage.usage(r, c, q), usage.rates_table(spark, RATES))
    assert rows(priced, "tier", "n_calls", "n_entries", "cost", "fee") == [("<unset>", 1000, 300, 27.75, 10.0)]


def test_orphan_calls_keep_their_run_index(spark):
    r = spark.createDataFrame([("1", "run_0", 0, "flex", 10, 0, 1, 0)], RUNS)
    c = spark.createDataFrame([("1", "run_0", 0, "search", None), ("1", "run_5", 2, "search", None)], CALLS)
    q = spark.createDataFrame([], "se10 string, run_key string, run_id int")
    used = usage.usage(r, c, q, ["run_id", "tier"])
    assert rows(used, "run_id", "tier", "n_runs", "n_calls") == [(0, "flex", 1, 1), (2, "<unset>", 0, 1)]
    slices = runs.run_slices(usage.with_cost(used, usage.rates_table(spark, RATES)))
    assert rows(slices, "run_id", "cost") == [(0, None), (2, 0.01)]
    cut = runs.cut_to(slices).first()
    assert (cut.cut_runs, cut.cut_calls, cut.cut_cost, cut.total_cost, cut.cut_cost_share) == (0, 1, 0.01, None, None)


def test_pricing_checks(spark):
    rates = usage.rates_table(spark, RATES)
    assert rows(usage.pricing_verified(rates)) == [(False, 2)]
    assert [m for (m,) in rows(usage.missing_rates(rates))] == sorted(f"flex.{f}" for f in usage.RATE_FIELDS)
    assert rows(usage.pricing_verified(usage.rates_table(spark, {"standard": RATES["standard"]}))) == [(True, 1)]
    assert rows(usage.pricing_verified(usage.rates_table(spark, {}))) == [(False, 0)]


def test_shared_prefix(spark):
    df = spark.createDataFrame([("You é are x",), ("You é are y and",), ("",), (None,)], "p string")
    (got,) = usage.shared_prefix(df, "p").collect()
    assert (got.n_prompts, got.prefix_chars, got.avg_prompt_chars, got.reaches_floor) == (2, 10, 13, False)
    same = spark.createDataFrame([("a" * 5000,)] * 2, "p string")
    (got,) = usage.shared_prefix(same, "p").collect()
    assert (got.prefix_chars, got.prefix_tokens, got.reaches_floor) == (5000, 1250, True)


def test_url_overlap_is_per_entity(spark):
    cited = spark.createDataFrame([("1", "u"), ("1", "u"), ("2", "u"), ("1", "")], "se10 string, url string")
    opened = spark.createDataFrame(
        [("1", "u", "open_page"), ("2", "v", "open_page"), ("2", "u", "search")], "se10 string, url string, action_type string"
    )
    assert rows(usage.url_overlap(cited, opened)) == [(2, 2, 1, 0.5, False)]


def test_third_run_partition(spark):
    data = [answer(1, r, 1, t) for r, t in ((0, "A "), (3, "a"), (7, "b"))]
    data += [answer(2, r, 1, t) for r, t in enumerate("aba")] + [answer(3, r, 1, t) for r, t in enumerate("abc")]
    data += [answer(4, 0, 1, None), answer(4, 1, 1, ""), answer(5, 0, 1, "x"), answer(6, None, 1, "x")]
    (got,) = runs.third_run(spark.createDataFrame(data, ANSWERS)).collect()
    assert (got.n_three, got.n_redundant, got.n_decisive, got.n_no_majority, got.n_pairs, got.n_pairs_agree) == (3, 1, 1, 1, 1, 1)


def test_scorecard(spark):
    data = [
        answer(1, 0, 1, "3"), answer(1, 1, 1, "3 - none", evidence="seen"), answer(2, None, 1, "NULL"),
        answer(2, 0, 2, "text", source="answer_dict"), answer(2, 1, 2, "3", source="answer_dict"), answer(3, 0, 2, None, ce="4"),
    ]
    cites = spark.createDataFrame(
        [("1", 1, 0, 1, "u"), ("1", 1, 0, 1, "u"), ("2", 2, None, 1, "u"), ("1", 1, 1, 1, "")], CITATIONS
    )
    got = {r.qnum: r for r in scorecard.scorecard(spark.createDataFrame(data, ANSWERS), cites).collect()}
    one, two = got[1], got[2]
    assert (one.n, one.n_scale, one.n_null, one.n_default3, one.n_noinfo, one.n_cited, one.kind) == (3, 2, 1, 1, 2, 2, "scale")
    assert (one.n_runs_agree, one.n_runs_multi, one.dict_differ_rate) == (0, 1, None)
    assert (two.n, two.n_ev_seen, two.n_default3, two.kind) == (3, 1, 0, "mixed")
    with pytest.raises(ValueError):
        scorecard.chosen_answer("other")


def test_defects(spark):
    data = [answer(1, 0, q, "x", source="answer_dict") for q in (1, 2)]
    data += [answer(1, 1, 1, "x"), answer(1, 1, 2, "x", source="answer_dict"), answer(2, 0, 1, "x")]
    a = spark.createDataFrame(data, ANSWERS)
    r = spark.createDataFrame([("1", "run_0", 0, None, 1, 0, 1, 0), ("9", "run_0", 0, None, 1, 0, 1, 0)], RUNS)
    rec = spark.createDataFrame([(1, "1", "f", 1), (2, "2", "f", 2)], "output_id bigint, se10 string, src_file string, src_line bigint")
    found = defects.run_defects(a, rec, r)
    assert rows(found, "defect", "output_id", "run_id") == [
        ("output_only", 2, 0), ("prose_partial+output_only", 1, 1), ("prose_unreadable", 1, 0)
    ]
    assert rows(defects.defect_crosstab(found)) == [
        ("prose UNREADABLE", 1, 0), ("prose ok", 0, 1), ("prose partial", 0, 1)
    ]
    assert rows(defects.defect_overlap(found), "n_both", "verdict") == [(0, "independent")]
    assert rows(health.reconcile_runs(r, a, rec)) == [(2, 3, 2, 1, 0)]


def test_empty_tables_give_zero_not_failure(spark):
    a, c = spark.createDataFrame([], ANSWERS), spark.createDataFrame([], CITATIONS)
    r = spark.createDataFrame([], RUNS)
    assert scorecard.scorecard(a, c).count() == 0
    assert rows(health.unreadable_runs(a)) == [(0, 0, 0)]
    assert usage.token_summary(r).first().hit_rate is None
    third = runs.third_run(a)
    assert runs.third_run_totals(third, r).first().redundant_rate is None
    q = spark.createDataFrame(
        [], "se10 string, query_text string, is_billed_query boolean, template string, n_placeholders int, archetype string, has_terms boolean"
    )
    assert masking.head_coverage(q).first().head_is_whole and masking.masking_totals(q).first().n_rows == 0


def test_gate_withholds_verbatim_queries(spark):
    q = spark.createDataFrame(
        [("1", "raw text", True, "raw text", 0, None), ("1", "x", True, "<NAME> x", 1, None), ("2", "x", True, "<NAME> x", 1, "g")],
        "se10 string, query_text string, is_billed_query boolean, template string, n_placeholders int, archetype string",
    )
    assert rows(masking.head_templates(q)) == [("<NAME> x", 2, 2, "g")]
    assert masking.head_templates(q, include_unmasked=True).count() == 2
    assert rows(masking.withheld_count(q)) == [(1,)] and rows(masking.withheld_count(q, True)) == [(0,)]


def test_label_values_hide_free_text(spark):
    raw = [('{"a": "%d", "b": "Y"}' % i,) for i in range(20)] + [("nope",)]
    m = spark.createDataFrame(raw, "raw_json string")
    assert rows(health.label_values(m, ["a", "b", "c"])) == [("a", None, 20, 20), ("b", "Y", 20, 0)]
    got = {r.key: (r.is_present, r.n_filled, r.n_distinct, r.n_records) for r in health.label_candidates(m, ["a", "b", "c"]).collect()}
    assert got == {"a": (True, 20, 20, 20), "b": (True, 20, 1, 20), "c": (False, 0, 0, 20)}
