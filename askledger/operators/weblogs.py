"""Web-search logs: JSON lines keyed by entity and run -> runs, calls, queries, anomalies.

`shred` turns each line into typed rows without a shuffle, problems riding along as arrays. It is
meant to be written once; runs, calls, queries and anomalies are then cheap reads of its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import text as tx
from askledger.functions import variants as va
from askledger.operators import anomaly as an
from askledger.operators.skew import HOT_ROWS, keep_first, spread_join

STAGE = "weblogs"
# Actions seen so far, the status of a call that worked.
KNOWN_ACTIONS = ("search", "open_page", "find_in_page")
COMPLETED = "completed"

USAGE_COLUMNS = {
    "service_tier": "string",
    "input_tokens": "bigint",
    "output_tokens": "bigint",
    "total_tokens": "bigint",
    "cache_read": "bigint",
    "reasoning": "bigint",
}
ORDER = ["src_rank", "src_file", "src_line"]
_RUN = "struct<usage_metadata: struct<{}>, web_search_calls: array<variant>>".format(
    ", ".join(f"{c}: variant" for c in USAGE_COLUMNS)
)
CALL_COLUMNS = ("call_id", "action_type", "status", "query_raw", "queries", "url", "details", "parse_conf")


def run_index(run_key: Column) -> Column:
    """Digits after the last underscore, or a key that is all digits; else NULL."""
    return F.nullif(F.regexp_extract(run_key, r"(?:^|_)([0-9]+)\z", 1), F.lit("")).try_cast("int")


def line_problems(value: Column, what: str) -> list[tuple[Column, Column]]:
    """What can be wrong with a line before its content is looked at."""
    head = F.col("raw")
    return [
        (F.col("is_damaged"), an.problem("ENCODING", F.lit(f"undecodable byte in {what}"), F.col("raw"))),
        (value.isNull(), an.problem("BAD_JSON_LINE", F.lit(f"{what} did not parse as JSON"), head)),
    ]


def parse_lines(bronze: DataFrame) -> DataFrame:
    """Lines that are not blank, parsed once; `v` is NULL where the text is not JSON."""
    # The list of one keeps the filter here: below, it would have every line decoded, or made, a second time.
    lines = bronze.select(F.explode_outer(F.array(F.struct(*bronze.columns))).alias("line")).select("line.*")
    return lines.filter(~tx.is_blank(F.col("raw"))).withColumn("v", F.try_parse_json("raw"))


_CALL_KEYS = ("id", "status", "action_type", "query", "queries", "url", "details")


def parse_calls(calls: Column) -> Column:
    """array<variant> of calls -> array of structs: fields, how well each parsed, what was wrong.

    Done in steps, each a transform over the one before: inside a lambda nothing is shared, so a
    value used twice has to be a field first.
    """
    opened = F.transform(
        calls,
        lambda c: F.struct(
            va.members(c, _CALL_KEYS).alias("m"),
            F.coalesce(va.dump(c), F.lit("null")).alias("raw_json"),
            c.alias("call"),
        ),
    )
    typed = F.transform(
        opened,
        lambda c: F.struct(
            c["m"].isNotNull().alias("is_object"),
            va.text_or_dump(c["m"]["action_type"]).alias("action"),
            va.text_or_dump(c["m"]["status"]).alias("any_status"),
            va.only_string(c["m"]["status"]).alias("status"),
            va.only_string(c["m"]["query"]).alias("query"),
            va.is_absent(c["m"]["queries"]).alias("no_queries"),
            va.as_array(c["m"]["queries"]).alias("any_queries"),
            va.only_string(c["m"]["id"]).alias("call_id"),
            va.only_string(c["m"]["url"]).alias("url"),
            va.only_string(c["m"]["details"]).alias("details"),
            c["raw_json"].alias("raw_json"),
            c["call"].alias("call"),
        ),
    )
    read = F.transform(
        typed,
        lambda c: F.struct(
            c.alias("t"),
            F.when(c["is_object"] & (c["action"] != ""), tx.strip(c["action"])).otherwise("?").alias("action"),
            F.transform(
                c["any_queries"],
                lambda q: F.coalesce(va.only_string(q), va.dump(q), F.lit("null")),
            ).alias("queries"),
        ),
    )

    def compared(c: Column) -> Column:
        t = c["t"]
        return F.struct(
            c.alias("c"),
            (~c["action"].isin(*KNOWN_ACTIONS)).alias("unknown"),
            (~t["no_queries"] & c["queries"].isNull()).alias("odd_queries"),
            ((c["action"] == "search") & t["query"].isNull()).alias("no_query"),
            ((c["action"] == "open_page") & t["url"].isNull()).alias("no_url"),
            # NULL when there is nothing to compare
            F.when(F.array_contains(c["queries"], t["query"]), "exact")
            .when(t["query"].isNull() | c["queries"].isNull(), F.lit(None))
            .when(
                F.array_contains(F.transform(c["queries"], tx.query_text), tx.query_text(t["query"])),
                "requoted",
            )
            .otherwise("absent")
            .alias("match"),
        )

    judged = F.transform(read, compared)

    def finished(j: Column) -> Column:
        c = j["c"]
        t = c["t"]
        notes = an.problems(
            (
                ~t["is_object"],
                an.problem("CALL_NOT_AN_OBJECT", F.format_string("expected an object, got %s", va.describe(t["call"]))),
            ),
            (
                t["is_object"] & j["unknown"],
                an.problem("UNKNOWN_ACTION_TYPE", F.format_string("action_type %s is not known", c["action"])),
            ),
            (
                t["any_status"].isNotNull() & ~t["status"].eqNullSafe(F.lit(COMPLETED)),
                an.problem("CALL_STATUS_NOT_COMPLETED", F.format_string("status is %s, not completed", t["any_status"])),
            ),
            (j["odd_queries"], an.problem("QUERIES_NOT_A_LIST", F.lit("queries is not a list"))),
            (
                j["match"] == "requoted",
                an.problem("QUERY_REQUOTED", F.lit("query is in queries only with other case or quoting")),
            ),
            (
                j["match"] == "absent",
                an.problem(
                    "QUERY_NOT_IN_QUERIES", F.format_string("query is not among its %d queries", F.size(c["queries"]))
                ),
            ),
            (j["no_query"], an.problem("CALL_FIELD_MISSING", F.lit("search call has no query"))),
            (j["no_url"], an.problem("CALL_FIELD_MISSING", F.lit("open_page call has no url"))),
        )
        return F.struct(
            t["call_id"].alias("call_id"),
            c["action"].alias("action_type"),
            t["status"].alias("status"),
            t["query"].alias("query_raw"),
            c["queries"].alias("queries"),
            t["url"].alias("url"),
            t["details"].alias("details"),
            F.when(~t["is_object"], "failed")
            .when(j["unknown"] | j["odd_queries"] | j["no_query"] | j["no_url"], "heuristic")
            .otherwise("clean")
            .alias("parse_conf"),
            t["raw_json"].alias("raw_json"),
            notes.alias("notes"),
        )

    return F.transform(judged, finished)


def shred(bronze: DataFrame) -> DataFrame:
    """One row per line, entity and run; lines and entities that have none keep one row.

    Write the result before reading facts from it, as each fact would parse the lines again.
    """
    lines = parse_lines(bronze).withColumn("members", va.as_object(F.col("v")))
    not_object = F.col("v").isNotNull() & F.col("members").isNull()
    by_entity = lines.select(
        *ORDER,
        an.problems(
            *line_problems(F.col("v"), "web-search log line"),
            (
                not_object,
                an.problem(
                    "WEBLOG_SHAPE_UNEXPECTED",
                    F.format_string("expected an object keyed by entity, got %s", va.describe(F.col("v"))),
                    F.col("raw"),
                ),
            ),
        ).alias("line_problems"),
        F.posexplode_outer(F.map_entries("members")).alias("ent_pos", "e"),
    ).select(
        *ORDER, "line_problems", "ent_pos", F.col("e.key").alias("se10"), F.col("e.value").alias("ent")
    )
    by_run = by_entity.withColumn("run_map", va.as_object(F.col("ent"))).select(
        *ORDER,
        # a problem of the line rides on its first entity only
        F.when(F.coalesce("ent_pos", F.lit(0)) == 0, F.col("line_problems")).alias("line_problems"),
        "ent_pos",
        "se10",
        F.when(
            F.col("se10").isNotNull() & F.col("run_map").isNull(),
            F.array(
                an.problem(
                    "WEBLOG_SHAPE_UNEXPECTED",
                    F.format_string("expected run keys under the entity, got %s", va.describe(F.col("ent"))),
                )
            ),
        ).alias("entity_problems"),
        F.col("run_map").isNotNull().alias("is_entity"),
        F.posexplode_outer(F.map_entries("run_map")).alias("run_pos", "r"),
    ).select(
        *ORDER, "line_problems", "ent_pos", "se10", "entity_problems", "is_entity", "run_pos",
        F.col("r.key").alias("run_key"), F.col("r.value").alias("run"),
    )
    opened = by_run.withColumn("m", va.shaped(F.col("run"), _RUN)).withColumn("usage", F.col("m.usage_metadata"))
    typed = opened.select(
        *by_run.columns,
        F.col("m").isNotNull().alias("is_run"),
        F.col("usage").isNotNull().alias("has_usage"),
        run_index(F.col("run_key")).alias("run_id"),
        *[
            (va.whole_number if kind == "bigint" else va.plain_text)(F.col(f"usage.{c}")).alias(c)
            for c, kind in USAGE_COLUMNS.items()
        ],
        *[va.only_integer(F.col(f"usage.{c}_tokens")).alias(f"_{c}") for c in ("input", "output", "total")],
        # what stands in the place of a list of calls is read again only where there is none
        F.when(F.col("m.web_search_calls").isNull(), va.field(F.col("run"), "web_search_calls")).alias("calls_any"),
        F.col("m.web_search_calls").alias("call_list"),
    )
    run_problems = an.problems(
        (
            F.col("run_key").isNotNull() & ~F.col("is_run"),
            an.problem(
                "WEBLOG_SHAPE_UNEXPECTED",
                F.format_string("run %s is %s, expected an object", "run_key", va.describe(F.col("run"))),
            ),
        ),
        (
            F.col("is_run") & F.col("run_id").isNull(),
            an.problem("RUN_KEY_UNPARSED", F.format_string("run key %s has no index", "run_key"), F.col("run_key")),
        ),
        (
            F.col("is_run") & ~F.col("has_usage"),
            an.problem("MISSING_USAGE_METADATA", F.format_string("run %s has no usage_metadata", "run_key")),
        ),
        (
            F.col("_input") + F.col("_output") != F.col("_total"),
            an.problem(
                "TOKEN_SUM_MISMATCH",
                F.format_string("run %s: input %d + output %d is not total %d", "run_key", "_input", "_output", "_total"),
            ),
        ),
        (
            F.col("is_run") & ~va.is_absent(F.col("calls_any")) & F.col("call_list").isNull(),
            an.problem(
                "WEBLOG_SHAPE_UNEXPECTED",
                F.format_string("run %s: web_search_calls is %s", "run_key", va.describe(F.col("calls_any"))),
            ),
        ),
    )
    return typed.select(
        *ORDER, "line_problems", "ent_pos", "se10", "entity_problems", "is_entity", "run_pos", "run_key",
        "is_run", "run_id", *USAGE_COLUMNS,
        run_problems.alias("run_problems"),
        parse_calls(F.col("call_list")).alias("calls"),
    )


def all_runs(shredded: DataFrame) -> DataFrame:
    """Every run as read, copies included."""
    return shredded.filter("is_run").select(
        "se10", "run_id", "run_key", *USAGE_COLUMNS, *ORDER
    )


def runs(shredded: DataFrame) -> DataFrame:
    """One row per (entity, run key): the first by file and line."""
    return keep_first(all_runs(shredded), ["se10", "run_key"], ORDER)


def duplicate_runs(shredded: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Later copies of a run, with the place of the first."""
    keys = ["se10", "run_key"]
    rows = shredded.filter("is_run").select(*keys, "src_rank", "src_file", "src_line", "ent_pos", "run_pos")
    repeated = (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*ORDER)).alias("first"), F.count(F.lit(1)).alias("n_copies"))
        .filter("n_copies > 1")
    )
    return spread_join(rows, repeated, keys, "inner", ORDER, min_hot).filter(
        F.struct(*ORDER) > F.col("first")
    )


def search_calls(shredded: DataFrame) -> DataFrame:
    """Every call, with its run key and its place in the run."""
    return shredded.filter("is_run").select(
        "se10", "run_key", "run_id", F.posexplode("calls").alias("call_index", "c"), *ORDER
    ).select("se10", "run_key", "run_id", "call_index", "c.*", *ORDER)


def query_instances(calls: DataFrame) -> DataFrame:
    """The billed query of a call, then its other queries; nothing for calls without any."""
    entry = "struct<query_text:string,is_billed_query:boolean>"
    billed = F.when(
        F.col("query_raw").isNotNull(),
        F.array(F.struct(F.col("query_raw").alias("query_text"), F.lit(True).alias("is_billed_query"))),
    )
    others = F.transform(
        F.filter("queries", lambda q: ~q.eqNullSafe(F.col("query_raw"))),
        lambda q: F.struct(q.alias("query_text"), F.lit(False).alias("is_billed_query")),
    )
    none = F.array().cast(f"array<{entry}>")
    return calls.select(
        "se10", "run_key", "run_id", "call_index", *ORDER,
        F.posexplode(F.concat(F.coalesce(billed, none), F.coalesce(others, none))).alias("q_ord", "q"),
    ).select("se10", "run_key", "run_id", "call_index", "q_ord", "q.*", *ORDER)


def call_anomalies(calls: DataFrame, stage: str) -> DataFrame:
    notes = calls.select(
        "se10", "src_file", "src_line", "run_key", "call_index", "raw_json",
        F.posexplode("notes").alias("pos", "p"),
    )
    return an.anomaly(
        notes, stage, F.col("p.code"), F.col("p.detail"), F.col("raw_json"),
        seq=an.run_number(F.col("se10"), F.col("run_key")) + F.shiftleft(F.col("call_index").cast("bigint"), 8) + F.col("pos"),
    )


def _place() -> Column:
    """Number of a run in its line, by entity and run, with room for 33 million problems of the run."""
    return F.shiftleft(F.coalesce("ent_pos", F.lit(0)).cast("bigint"), 41) + F.shiftleft(F.coalesce("run_pos", F.lit(0)).cast("bigint"), 25)


def _all_problems(shredded: DataFrame) -> DataFrame:
    """Every problem found inside a row, with the entity it belongs to, by one explode."""

    def owned(column: str, se10: Column) -> Column:
        return F.transform(column, lambda p: F.struct(se10.alias("se10"), p.alias("p")))

    def of_call(call: Column, index: Column) -> Column:
        where = F.format_string("run_id=%s call %d: ", F.col("run_id").cast("string"), index)
        return F.transform(
            call["notes"],
            lambda p: F.struct(
                F.col("se10").alias("se10"),
                F.named_struct(
                    F.lit("code"), p["code"],
                    F.lit("excerpt"), call["raw_json"],
                    F.lit("detail"), F.concat(where, p["detail"]),
                ).cast(an.PROBLEM).alias("p"),
            ),
        )

    none = F.array().cast(f"array<struct<se10:string,p:{an.PROBLEM}>>")
    parts = [
        owned("line_problems", F.lit(None).cast("string")),
        owned("entity_problems", F.col("se10")),
        owned("run_problems", F.col("se10")),
        F.flatten(F.transform("calls", of_call)),
    ]
    flat = shredded.select(
        "src_file", "src_line",
        _place().alias("base"),
        F.posexplode(F.concat(*[F.coalesce(part, none) for part in parts])).alias("pos", "x"),
    ).select("src_file", "src_line", "x.se10", "x.p", (F.col("base") + F.col("pos")).alias("seq"))
    return an.anomaly(
        flat, STAGE, F.col("p.code"), F.col("p.detail"), F.col("p.excerpt"), seq=F.col("seq")
    )


def anomalies(shredded: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Everything that was wrong in the logs."""
    copies = an.anomaly(
        duplicate_runs(shredded, min_hot), STAGE, "DUP_RUN",
        F.format_string(
            "run %s was already read at %s:%d; its calls join that one",
            "run_key", "first.src_file", "first.src_line",
        ),
        seq=_place(),
    )
    return _all_problems(shredded).unionByName(copies)


def reparse_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, queries and anomalies again from the stored JSON of each call, no file read.

    The queries come without template or archetype, so masking has to run again.
    """
    kept = [c for c in calls.columns if c not in CALL_COLUMNS and c not in ("notes", "raw_json")]
    again = calls.select(*kept, "raw_json", F.get(parse_calls(F.array(F.try_parse_json("raw_json"))), 0).alias("c")).select(
        *kept, *[f"c.{c}" for c in CALL_COLUMNS], "raw_json", "c.notes"
    )
    return again, query_instances(again), call_anomalies(again, "reparse")
