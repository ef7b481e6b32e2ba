import json

from pyspark.sql import functions as F
from support import rows

from askledger.operators import anomaly as an
from askledger.operators import entities as en
from askledger.operators import records as rc
from askledger.operators import weblogs as wl
from askledger.sources.staging import staged


def shred(module, lines):
    """Shredded rows, written once as the pipeline does."""
    return staged(module.shred(lines))


def codes(found):
    return rows(found, "code", "src_line")


def one_run(calls=(), key="run_0", usage=None, se10="1"):
    usage = {"input_tokens": 5, "output_tokens": 2, "total_tokens": 7} if usage is None else usage
    return json.dumps({se10: {key: {"usage_metadata": usage, "web_search_calls": calls}}})


def test_call_fields_and_confidence(bronze):
    calls = [
        {"id": "a", "status": "completed", "action_type": " search ", "query": "q", "queries": ["q", {"b": 1, "a": 2}, None]},
        {"action_type": "new", "status": 5, "url": ["x"]},
        {"action_type": "open_page"},
        "text",
        {"action_type": None, "query": "q", "queries": "q"},
    ]
    shredded = shred(wl, bronze([one_run(calls)]))
    got = wl.search_calls(shredded).orderBy("call_index").collect()
    assert [(c.action_type, c.parse_conf) for c in got] == [
        ("search", "clean"), ("new", "heuristic"), ("open_page", "heuristic"), ("?", "failed"), ("?", "heuristic"),
    ]
    assert got[0].queries == ["q", '{"a":2,"b":1}', "null"] and got[1].status is None and got[1].url is None
    assert [[n.code for n in c.notes] for c in got] == [
        [], ["UNKNOWN_ACTION_TYPE", "CALL_STATUS_NOT_COMPLETED"], ["CALL_FIELD_MISSING"], ["CALL_NOT_AN_OBJECT"],
        ["UNKNOWN_ACTION_TYPE", "QUERIES_NOT_A_LIST"],
    ]
    assert rows(wl.query_instances(wl.search_calls(shredded)), "call_index", "q_ord", "query_text", "is_billed_query") == [
        (0, 0, "q", True), (0, 1, '{"a":2,"b":1}', False), (0, 2, "null", False), (4, 0, "q", True),
    ]


def test_query_membership_tiers(bronze):
    calls = [
        {"action_type": "search", "status": "completed", "query": '"MARIANNA" "City, CA"', "queries": qs}
        for qs in (['"MARIANNA" "City, CA"'], ['"Marianna" "City" "CA"'], ["other"])
    ]
    found = wl.anomalies(shred(wl, bronze([one_run(calls)])))
    assert rows(found, "code") == [("QUERY_NOT_IN_QUERIES",), ("QUERY_REQUOTED",)]


def test_malformed_logs_never_stop_their_neighbours(bronze):
    lines = [
        "[1]", "{bad", "", "  ", '{"1": 5}', '{"1": {"run_0": []}}', '{"1": {"run_0": {"web_search_calls": {}}}}',
        one_run(key="retry_final"), one_run(usage={"input_tokens": 5, "output_tokens": 2, "total_tokens": 8}, se10="2"),
        one_run(), '{"3": {"batch_7": {"usage_metadata": {}}}, "4": null}',
    ]
    shredded = shred(wl, bronze(lines))
    assert codes(wl.anomalies(shredded)) == sorted(
        [
            ("WEBLOG_SHAPE_UNEXPECTED", 1), ("BAD_JSON_LINE", 2), ("WEBLOG_SHAPE_UNEXPECTED", 5),
            ("WEBLOG_SHAPE_UNEXPECTED", 6), ("WEBLOG_SHAPE_UNEXPECTED", 7), ("MISSING_USAGE_METADATA", 7),
            ("RUN_KEY_UNPARSED", 8), ("TOKEN_SUM_MISMATCH", 9), ("DUP_RUN", 10), ("WEBLOG_SHAPE_UNEXPECTED", 11),
        ],
        key=repr,
    )
    assert rows(wl.runs(shredded), "se10", "run_key", "run_id", "src_line") == [
        ("1", "retry_final", None, 8), ("1", "run_0", 0, 7), ("2", "run_0", 0, 9), ("3", "batch_7", 7, 11),
    ]


def test_calls_of_a_repeated_run_stay(bronze):
    lines = [one_run([{"action_type": "search", "query": q}]) for q in "ab"]
    calls = wl.search_calls(shred(wl, bronze(lines)))
    assert rows(calls, "run_key", "query_raw", "src_line") == [("run_0", "a", 1), ("run_0", "b", 2)]


def test_token_types(bronze):
    usage = {"input_tokens": "7", "output_tokens": 1.5, "total_tokens": True, "cache_read": 2.0, "service_tier": 3}
    (run,) = wl.runs(shred(wl, bronze([one_run(usage=usage)]))).collect()
    assert (run.input_tokens, run.output_tokens, run.total_tokens, run.cache_read, run.service_tier) == (7, None, 1, 2, "3")


def test_duplicate_json_key_keeps_the_last(bronze):
    (run,) = wl.runs(shred(wl, bronze(['{"1": {"run_0": {"usage_metadata": {"input_tokens": 1, "input_tokens": 2}}}}']))).collect()
    assert run.input_tokens == 2


def test_reparse_gives_the_same_calls(bronze):
    calls = wl.search_calls(shred(wl, bronze([one_run([{"action_type": "search"}, 3, {"action_type": "open_page", "url": "u"}])])))
    again, queries, found = wl.reparse_calls(calls.drop("notes"))
    same = ["call_index", "action_type", "parse_conf", "url", "raw_json"]
    assert rows(again, *same) == rows(calls, *same) and queries.count() == 0
    assert rows(found, "stage", "code") == [("reparse", "CALL_FIELD_MISSING"), ("reparse", "CALL_NOT_AN_OBJECT")]


def test_damaged_lines_are_reported_and_still_parsed(bronze):
    good = one_run([{"action_type": "search", "query": "caf�"}])
    found = wl.anomalies(shred(wl, bronze([good, good.replace("run_0", "run_1").replace("\\ufffd", "�")])))
    assert codes(found) == [("ENCODING", 1), ("ENCODING", 2)]


def test_entities(bronze):
    lines = [
        json.dumps({"se10": 5, "se_toc_name": " The  Acme LLC. ", "Seller_Email_Address": "Info@Acme.example",
                    "Business_Phone_No": "(555) 010-2233", "website": ["a"], "sell_pstl_cd": "AB", "extra": 1}),
        json.dumps({"se10": "5", "website": "late"}), "[]", '{"se10": ""}', "{", '{"se10": "6"}',
    ]
    shredded = shred(en, bronze(lines, "input"))
    kept = en.merchants(shredded)
    assert rows(kept, "se10", "website", "src_line") == [("5", '["a"]', 1), ("6", None, 6)]
    assert rows(en.pii_terms(kept), "se10", "field", "value_norm") == sorted(
        ("5", f, v) for f, v in [
            ("name", "the acme llc"), ("email", "info@acme.example"), ("email", "info"), ("email", "acme.example"),
            ("phone", "555) 010-2233"), ("phone", "5550102233"),
        ]
    )
    assert rows(en.without_terms(kept)) == [(2, 6, 1)]
    assert codes(en.anomalies(shredded)) == [
        ("BAD_JSON_LINE", 5), ("DUP_INPUT_SE10", 2), ("MERCHANT_NO_SE10", 4), ("RECORD_NOT_AN_OBJECT", 3)
    ]


PROMPT = "Intro\nQ1. a\nQ2. b\nQ3. c"


def record(**changes):
    base = {
        "se10": "1", "n_runs": 2, "questions": [["s", PROMPT]],
        "answer": {"run_0": "Q1. a\nA1. 2\nEvidence. x ([t](https://H/1)) ([]())\n\nQ2. b\nA2. NULL", "run_1": "A1. 3\nA2. null\nA3. x"},
        "answer_dict": {
            "run_0": {"A1": "2 ", "A2": "x", "A3": "5", "note": "n"}, "run_1": {"A1": 3},
            "voted_majority": {"A1": ["2", "2"], "A2": ["a", "b"], "A3": True}, "voted_final": {"A1": "2", "A3": "no"},
        },
        "citation_evidence": {
            "run_0": [
                {"a_key": "A1", "answer": "2", "citation": "https://H/2", "evidence": "x", "question": "q"},
                {"a_key": "A2", "citation": ["u1", "u2"], "answer": None}, 7, {"a_key": "A7", "answer": "z"},
            ],
            "run_1": {"A1": 1},
        },
        "website": "W",
    }
    return json.dumps({k: v for k, v in {**base, **changes}.items() if v != "drop"})


def shredded_records(bronze, *lines):
    records = rc.shred_records(bronze(lines, "output"))
    return staged(records.drop("run_parts")), staged(rc.shred_runs(records))


def test_three_way_merge(bronze):
    _, runs = shredded_records(bronze, record())
    got = rows(rc.answers(runs), "run_id", "qnum", "answer_text", "parsed_from", "agree_with_dict", "agree_with_ce", "is_null")
    assert got == sorted(
        [
            (0, 1, "2", "answers_text", True, True, False), (0, 2, "NULL", "answers_text", False, None, True),
            (0, 3, "5", "answer_dict", None, None, False), (0, 7, "z", "citation_evidence", None, True, False),
            (1, 1, "3", "answers_text_bare", True, None, False), (1, 2, "null", "answers_text_bare", None, None, True),
            (1, 3, "x", "answers_text_bare", None, None, False),
        ],
        key=repr,
    )


def test_citations_and_votes(bronze):
    records, runs = shredded_records(bronze, record())
    assert rows(rc.citations(runs), "qnum", "url", "domain", "source", "empty_placeholder") == sorted(
        [
            (1, "https://H/1", "h", "markdown_prose", False), (1, None, None, "markdown_prose", True),
            (1, "https://H/2", "h", "citation_evidence", False), (2, "u1", None, "citation_evidence", False),
            (2, "u2", None, "citation_evidence", False), (7, None, None, "citation_evidence", True),
        ],
        key=repr,
    )
    assert rows(rc.votes(records), "a_key", "voted_majority", "voted_final", "differs") == [
        ("A1", "2", "2", False), ("A2", '["a","b"]', None, False), ("A3", "True", "no", True)
    ]


def test_record_anomalies(spark, bronze):
    merchants = spark.createDataFrame([("1", "other", None, None)], "se10 string, website string, industry_tagged string, state string")
    records, runs = shredded_records(
        bronze, record(se10="0", questions=[]), record(), record(), record(se10="2", questions=[["s", "Q1. a\nQ4. d"]], answer=[]),
        record(se10=None), "[]", record(se10="3", answer={"final": "A1. 2"}, citation_evidence="drop", answer_dict="drop"),
    )
    found = {(c, n) for c, n in codes(rc.anomalies(records, runs, merchants))}
    assert {c for c, n in found if n == 1} >= {"OUTPUT_NO_QUESTIONS"} and ("ANSWER_BLOCK_COUNT", 1) not in found
    assert {c for c, n in found if n == 2} == {
        "ANSWER_BLOCK_COUNT", "ANSWER_PARSE_MISMATCH", "CITATION_ENTRIES_NOT_A_LIST", "CITATION_SHAPE_UNEXPECTED",
        "CITATION_SOURCE_MISMATCH", "VOTE_VALUE_LIST", "INPUT_OUTPUT_FIELD_CONFLICT",
    }
    assert ("DUP_OUTPUT_SE10", 3) in found and ("QUESTION_SET_DRIFT", 4) in found and ("OUTPUT_NO_ANSWERS", 4) in found
    assert ("OUTPUT_NO_SE10", 5) in found and ("RECORD_NOT_AN_OBJECT", 6) in found
    assert {c for c, n in found if n == 7} == {
        "OUTPUT_NO_CITATION_EVIDENCE", "OUTPUT_NO_VOTES", "RUN_KEY_UNPARSED", "ANSWER_BLOCK_COUNT"
    }
    assert rows(rc.duplicate_records(records), "src_line", "identical", "n_copies") == [(3, True, 2)]
    assert rows(rc.output_records(records).filter("dup_flag"), "src_line") == [(2,), (3,)]
    assert rows(rc.questions(records)) == [(1, "a"), (2, "b"), (3, "c")]


def test_malformed_records_never_fail(bronze):
    odd = [None, 5, "x", [], {}, [[]], [5], [[1, 2]], {"run_0": 5}, {"run_0": {"A1": None}}, {"run_0": [None, 3]}]
    lines = [
        record(**{key: value}) for key in ("questions", "answer", "answer_dict", "citation_evidence", "n_runs") for value in odd
    ]
    records, runs = shredded_records(bronze, *lines)
    assert records.count() == len(lines)
    for df in (rc.answers(runs), rc.citations(runs), rc.votes(records), an.from_problems(runs, "outputs")):
        df.collect()


def test_order_numbers_tell_all_problems_of_a_line_apart(spark, bronze):
    call = {"action_type": "odd", "query": "a", "queries": ["b"]}
    line = json.dumps({e: {f"run_{r}": {"web_search_calls": [call] * 4} for r in (0, 1, 2)} for e in ("1", "2")})
    found = wl.anomalies(wl.shred(bronze([line, line])))
    again = wl.call_anomalies(wl.search_calls(wl.shred(bronze([line]))), "reparse")
    for df in (found, again):
        key = df.groupBy("stage", "code", "src_file", "src_line", "seq").count()
        assert df.count() > 20 and key.filter("count > 1").count() == 0


def test_rows_made_into_several_are_dealt_over_parts_first(spark, tmp_path, monkeypatch):
    """A task's memory must not follow the size of the table: a table of one split gets a part for so many rows."""
    from askledger.plans import binding

    spark.range(300).selectExpr("id as o_orderkey", "id % 40 as o_custkey", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(40).selectExpr("id as c_custkey", "concat('C#', id) as c_name", "'BUILDING' as c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(binding, "EXPLODED_ROWS", 10)
    queries, terms = binding.entity_queries(spark, str(tmp_path)), binding.terms(spark, str(tmp_path))
    assert queries.rdd.getNumPartitions() == 30 and queries.count() == 1800
    assert terms.rdd.getNumPartitions() >= 4 and terms.select("se10").distinct().count() == 40 - len([k for k in range(40) if k % 13 == 7 or k % 17 == 5])


def test_lines_are_made_once(spark):
    """The test for blank lines stays above the lines: below, each line would be made a second time for it."""
    made = spark.range(3).selectExpr("0 as src_rank", "'f' as src_file", "id as src_line", "concat('marker', id) as raw", "false as is_damaged")
    plan = wl.parse_lines(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(marker") == 1 and wl.parse_lines(made).count() == 3


def test_escaped_marks_of_damage_in_any_case(spark):
    from askledger.sources.lines import is_damaged

    lines = ['"\\ufffd"', '"\\UFFFD"', '"\\uFfFd"', '"\\u00e9"', "ufffd", "�", "\\", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", is_damaged(F.col("x")).alias("d"))
    assert [d for _, d in rows(df)] == [True, True, True, False, False, True, False, False, None]


def test_runs_of_odd_shape(bronze):
    """A list of calls that is none, usage that is none, and both at once, beside a good run."""
    lines = [
        '{"1": {"run_0": {"usage_metadata": 5, "web_search_calls": {"a": 1}}, "run_1": {"usage_metadata": {"input_tokens": "x", "reasoning": 3}}}}',
        '{"1": {"run_2": {"web_search_calls": null, "usage_metadata": []}, "run_3": {"web_search_calls": [null, {"query": {"b": 1}}]}, "run_4": 7}}',
    ]
    shredded = shred(wl, bronze(lines))
    assert rows(wl.runs(shredded), "run_key", "input_tokens", "reasoning") == [
        ("run_0", None, None), ("run_1", None, 3), ("run_2", None, None), ("run_3", None, None)
    ]
    details = rows(wl.anomalies(shredded).filter("code = 'WEBLOG_SHAPE_UNEXPECTED'"), "detail")
    assert details == [("run run_0: web_search_calls is object{a}",), ("run run_4 is bigint, expected an object",)]
    assert rows(wl.search_calls(shredded), "run_key", "call_index", "parse_conf", "raw_json") == [
        ("run_3", 0, "failed", "null"), ("run_3", 1, "heuristic", '{"query":{"b":1}}')
    ]
