import duckdb

from askledger.llm import chat

CALL = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>, extra int, status string"
RESULT = "conv_id long, call_id string, position long, content string, level int"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def linked(spark, calls, results):
    out = chat.link(spark.createDataFrame([(*c, 1, "x") for c in calls], CALL), spark.createDataFrame([(*r, 1) for r in results], RESULT), SCHEMAS)
    return {(r.call_id, r.status, r.position): r for r in out.collect()}


def test_links_orders_checks_and_serialises(spark):
    good = '{ "b": 2.50, "a": 1, "note": "x\\n\\"y\\"" }'
    found = linked(
        spark,
        [
            (1, "c", 3, "add", good, ["b", "a", "b"]), (1, "b", 2, "add", good, ["a"]), (1, "a", 1, "add", good, []), (1, "d", 4, "add", '{"a": "1", "c": [1]}', ["gone", "d"]),
            (2, "e", 1, "add", good, ["f"]), (2, "f", 2, "add", good, ["e"]), (2, "g", 3, "add", good, ["f"]), (3, "h", 1, "sub", "[1]", None), (3, None, 1, "add", good, []),
            (4, "a", 9, "add", good, []), (1, "a", 1, "add", good, []), (3, "i", 2, None, None, None), (3, "j", 3, "sub", "{}", []),
        ],
        [(1, "a", 5, "later"), (1, "a", 4, "first"), (1, "a", 4, "first"), (9, "zz", 1, "lost"), (9, None, 2, None)],
    )
    assert len(found) == 14
    a = found["a", "linked", 1]
    assert (a.level, a.n_results, a.valid) == (0, 2, True)
    assert a.record == '{"arguments":{"a":1,"b":2.5,"note":"x\\n\\"y\\""},"call_id":"a","level":0,"name":"add","result":"first","status":"linked"}'
    assert [found[k, "unanswered", p].level for k, p in (("b", 2), ("c", 3), ("d", 4))] == [1, 2, 0]
    assert '"depends_on":["a","b"]' in found["c", "unanswered", 3].record
    assert found["d", "unanswered", 4].errors == "a is not of type integer; b is missing; c is not known; cannot depend on d; cannot depend on gone"
    assert all(found[k].level is None and found[k].errors == "cycle" for k in found if k[0] in ("e", "f", "g"))
    assert found["h", "unanswered", 1].errors == "arguments are not an object" and found["j", "unanswered", 3].errors == "no such tool: sub"
    assert (None, "no_id", 1) in found and ("a", "repeated", 9) in found and found["zz", "orphan", 1].valid and (None, "orphan", 2) in found


def test_levels_of_long_chains_and_joins_of_them(spark):
    chain = [(f"c{k}", [f"c{k - 1}"] if k else []) for k in range(300)]
    more = [("m", ["c7", "c250", "x"]), ("x", []), ("n", ["m"]), ("o", ["n", "c2"]), ("p", ["q", "c1"]), ("q", ["r"]), ("r", ["q"]), ("s", ["p"])]
    found = linked(spark, [(1, i, 0, "add", "{}", on) for i, on in chain + more], [])
    level = {k[0]: r.level for k, r in found.items()}
    assert all(level[f"c{k}"] == k for k in range(300))
    assert (level["m"], level["n"], level["o"], level["x"]) == (251, 252, 253, 0) and all(level[k] is None for k in "pqrs")


def test_empty(spark):
    assert linked(spark, [], []) == {}


def test_derived_conversations_agree_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    mine = chat.linked_turns(spark.read.parquet(f"{folder}/conversations.parquet"))
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted(con.sql(chat.ORACLE_SQL).fetchall(), key=repr)


def test_every_turn_has_its_row(spark):
    turns = [(1, 0, "system", 'be "brief"'), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 3, "tool", "t"), (1, 4, None, None), (5, 0, "user", "whole"), (6, 0, "critic", "")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    mine = sorted(map(tuple, chat.linked_turns(frame).collect()), key=repr)
    assert mine == sorted(con.sql(chat.ORACLE_SQL).fetchall(), key=repr) and len(mine) == 6
    records = {(r[0], r[4]): r[8] for r in mine}
    assert records[1, 0] == '{"content":"be \\"brief\\"","role":"system","status":"message"}' and records[1, 4] == '{"status":"message"}'
    assert '"text":"whole"' in records[5, 0] and '"result":"a"' in records[1, 1]
