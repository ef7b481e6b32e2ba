"""Output records: JSON lines -> records, questions, answers, citations, votes, anomalies.

One line holds all runs of an entity. `shred_records` types the line, `shred_runs` its runs;
both stay inside the row, so neither shuffles. Only what compares records with each other
(duplicates, the canonical question set, the input side) joins or groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.functions import prose
from askledger.functions import text as tx
from askledger.functions import variants as va
from askledger.operators import anomaly as an
from askledger.operators.entities import record_key
from askledger.operators.skew import HOT_ROWS, spread_join
from askledger.operators.weblogs import ORDER, line_problems, parse_lines

STAGE = "outputs"
# Record field -> merchants column it repeats.
REPEATED_FIELDS = {"website": "website", "industry": "industry_tagged", "state": "state"}
VOTE_KEYS = ("voted_majority", "voted_final")
_ENTRY_KEYS = ("a_key", "answer", "evidence", "question", "citation")

_RUN_KEY = r"(?i)\Arun[_-]?([0-9]+)\z"
_ANSWER_KEY = r"(?i)\AA([0-9]+)\z"


def run_index(run_key: Column) -> Column:
    """Index of a run_<n> key, stricter than on the log side; NULL otherwise."""
    return F.nullif(F.regexp_extract(tx.strip(run_key), _RUN_KEY, 1), F.lit("")).try_cast("int")


def question_number(answer_key: Column) -> Column:
    """Number of an A<n> key; NULL otherwise."""
    return F.nullif(F.regexp_extract(tx.strip(answer_key), _ANSWER_KEY, 1), F.lit("")).try_cast("int")


def output_id(src_file: Column, src_line: Column) -> Column:
    """A record is its place in the sources."""
    return F.concat_ws(":", src_file, src_line.cast("string"))


def _keys_of(value: Column) -> Column:
    return tx.capped_list(F.sort_array(F.map_keys(va.as_object(value))))


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def vote(value: Column) -> Column:
    """struct(text, odd): one vote. Equal list members count as one, a mixed list as unresolved."""
    members = va.as_array(value)
    dumps = F.array_distinct(F.transform(members, lambda m: F.coalesce(va.dump(m), F.lit("null"))))
    first = F.get(members, 0)
    truth = F.initcap(F.try_variant_get(value, "$", "boolean").cast("string"))
    is_list, is_map = members.isNotNull(), va.as_object(value).isNotNull()
    text = (
        F.when(va.is_absent(value) | (is_list & (F.size(members) == 0)), F.lit(None).cast("string"))
        .when(is_list & (F.size(dumps) == 1), F.coalesce(va.only_string(first), F.get(dumps, 0)))
        .when(va.scalar_kind(value) == "BOOLEAN", truth)
        .otherwise(va.text_or_dump(value))
    )
    odd = F.coalesce((is_list & (F.size(dumps) > 1)) | (is_map & ~is_list), F.lit(False))
    return F.struct(text.alias("text"), odd.alias("odd"))


def shred_records(bronze: DataFrame) -> DataFrame:
    """One row per line: record columns, questions, votes, its runs as raw parts, its problems.

    Write the result (without run_parts) before reading facts from it: a filter on a column computed here
    would otherwise be pushed below the parse, and parse again.
    """
    v = F.col("v")
    keys_read = ("se10", "n_runs", "questions", "answer", "answer_dict", "citation_evidence", *REPEATED_FIELDS)
    typed = parse_lines(bronze).withColumn("m", va.members(v, keys_read)).select(
        *ORDER, "raw", "is_damaged", "v", "m",
        F.col("m").isNotNull().alias("is_object"),
        record_key(F.col("m.se10")).alias("se10"),
        F.col("m.questions").alias("q_any"),
        F.col("m.answer").alias("a_any"),
        F.col("m.answer_dict").alias("d_any"),
        F.col("m.citation_evidence").alias("c_any"),
    )
    system, user = (va.only_string(va.item(va.item(F.col("q_any"), 0), i)) for i in (0, 1))
    opened = typed.withColumns(
        {
            "is_record": F.col("se10").isNotNull() & F.col("is_object"),
            "question_system_prompt": system,
            "question_user_prompt": F.nullif(user, F.lit("")),
            "questions": prose.questions(F.coalesce(user, F.lit(""))),
            "a_map": va.as_object(F.col("a_any")),
            "d_map": va.as_object(F.col("d_any")),
            "c_map": va.as_object(F.col("c_any")),
            "majority": va.as_object(va.field(F.col("d_any"), VOTE_KEYS[0])),
            "final": va.as_object(va.field(F.col("d_any"), VOTE_KEYS[1])),
        }
    )

    def keys(name: str) -> Column:
        return F.coalesce(F.map_keys(name), _no_keys())

    def parts(key: Column) -> Column:
        return F.struct(
            key.alias("run_key"),
            F.element_at("a_map", key).alias("said"),
            F.element_at("d_map", key).alias("theirs"),
            F.element_at("c_map", key).alias("entries"),
            F.array_contains(keys("c_map"), key).alias("has_entries"),
        )

    def one_vote(key: Column) -> Column:
        return F.struct(
            key.alias("a_key"),
            vote(F.element_at("majority", key)).alias("m"),
            vote(F.element_at("final", key)).alias("f"),
            F.concat(
                F.lit('{"voted_final": '), F.coalesce(va.dump(F.element_at("final", key)), F.lit("null")),
                F.lit(', "voted_majority": '), F.coalesce(va.dump(F.element_at("majority", key)), F.lit("null")),
                F.lit("}"),
            ).alias("raw_vote"),
        )

    n_runs = va.only_integer(F.col("m.n_runs"))
    n_answers = F.size(keys("a_map"))
    votes = F.transform(F.sort_array(F.array_union(keys("majority"), keys("final"))), one_vote)
    rows = opened.select(
        "*",
        n_runs.alias("n_runs"),
        n_answers.alias("n_answer_runs"),
        votes.alias("votes"),
        F.transform(F.sort_array(F.array_union(keys("a_map"), keys("c_map"))), parts).alias("run_parts"),
    )
    head = F.col("raw")
    is_record = F.col("is_record")
    top = _keys_of(v)
    found = an.problems(
        *line_problems(v, "output record"),
        (
            v.isNotNull() & ~F.col("is_object"),
            an.problem("RECORD_NOT_AN_OBJECT", F.format_string("output record is %s", va.describe(v)), head),
        ),
        (
            F.col("is_object") & F.col("se10").isNull(),
            an.problem("OUTPUT_NO_SE10", F.lit("record has no se10; its answers belong to nobody"), head),
        ),
        (
            is_record & (F.size("questions") == 0),
            an.problem(
                "OUTPUT_NO_QUESTIONS",
                F.format_string(
                    "no question text; questions is %s; keys present: %s", va.describe(F.col("q_any")), top
                ),
            ),
        ),
        (
            is_record & (F.col("n_answer_runs") == 0),
            an.problem(
                "OUTPUT_NO_ANSWERS",
                F.format_string("answer is %s; keys present: %s", va.describe(F.col("a_any")), top),
            ),
        ),
        (
            is_record & (F.size(keys("c_map")) == 0),
            an.problem(
                "OUTPUT_NO_CITATION_EVIDENCE",
                F.format_string("citation_evidence is %s; keys present: %s", va.describe(F.col("c_any")), top),
            ),
        ),
        (
            is_record & (F.size("votes") == 0),
            an.problem(
                "OUTPUT_NO_VOTES",
                F.format_string("no usable votes; answer_dict has: %s", F.coalesce(_keys_of(F.col("d_any")), F.lit("-"))),
            ),
        ),
    )
    odd_votes = F.transform(
        F.filter("votes", lambda x: x["m"]["odd"] | x["f"]["odd"]),
        lambda x: an.problem(
            "VOTE_VALUE_LIST", F.format_string("%s: vote has differing members", x["a_key"]), x["raw_vote"]
        ),
    )
    return rows.select(
        *ORDER,
        output_id(F.col("src_file"), F.col("src_line")).alias("output_id"),
        "is_record",
        "se10",
        "n_runs",
        "n_answer_runs",
        "question_system_prompt",
        "question_user_prompt",
        F.substring(F.sha2("raw", 256), 1, 16).alias("raw_json_hash"),
        "questions",
        *[
            F.nullif(va.text_or_dump(F.col(f"m.{k}")), F.lit("")).alias(f"own_{k}")
            for k in REPEATED_FIELDS
        ],
        F.transform(
            "votes",
            lambda x: F.struct(
                x["a_key"].alias("a_key"),
                question_number(x["a_key"]).alias("qnum"),
                x["m"]["text"].alias("voted_majority"),
                x["f"]["text"].alias("voted_final"),
                (x["f"]["text"].isNotNull() & ~x["m"]["text"].eqNullSafe(x["f"]["text"])).alias("differs"),
            ),
        ).alias("votes"),
        (F.size(keys("final")) == 0).alias("empty_voted_final"),
        F.when(is_record, F.concat(found, odd_votes)).otherwise(found).alias("problems"),
        F.when(is_record, F.col("run_parts")).alias("run_parts"),
    )


def shred_runs(records: DataFrame) -> DataFrame:
    """One row per record and run: answers, citations and problems as arrays."""
    ids = [*ORDER, "output_id", "se10"]
    # explode_outer: a plain explode would have Spark test the array for emptiness first, below
    # the parse, which would parse every line once more for the test.
    parts = (
        records.select(*ids, F.explode_outer("run_parts").alias("p"))
        .filter("p.run_key is not null")
        .select(*ids, "p.*")
    )
    their_pairs = F.filter(
        F.transform(
            F.map_entries(va.as_object(F.col("theirs"))),
            lambda e, i: F.struct(
                question_number(e["key"]).alias("qnum"),
                i.alias("pos"),
                F.coalesce(va.only_string(e["value"]), va.dump(e["value"]), F.lit("null")).alias("text"),
            ),
        ),
        lambda t: t["qnum"].isNotNull(),
    )

    entry_list = va.as_array(F.col("entries"))
    # Steps, because nothing is shared inside a lambda: a value used twice is a field first.
    opened = F.filter(
        F.transform(entry_list, lambda e: va.members(e, _ENTRY_KEYS)), lambda m: m.isNotNull()
    )
    read = F.transform(
        opened,
        lambda m, i: F.struct(
            i.alias("pos"),
            va.text_or_dump(m["a_key"]).alias("a_key"),
            va.text_or_dump(m["answer"]).alias("answer"),
            va.text_or_dump(m["evidence"]).alias("evidence"),
            va.text_or_dump(m["question"]).alias("title"),
            m["citation"].alias("citation"),
            va.is_absent(m["citation"]).alias("no_citation"),
            va.only_string(m["citation"]).alias("one"),
            F.filter(
                F.transform(va.as_array(m["citation"]), va.only_string), lambda u: u.isNotNull()
            ).alias("many"),
        ),
    )

    def entry(e: Column) -> Column:
        odd = ~e["no_citation"] & e["one"].isNull()
        listed = F.when(F.size(e["many"]) > 0, e["many"]).otherwise(F.array(va.dump(e["citation"])))
        return F.struct(
            question_number(e["a_key"]).alias("qnum"),
            e["pos"].alias("pos"),
            e["answer"].alias("answer"),
            e["evidence"].alias("evidence"),
            e["title"].alias("title"),
            e["a_key"].alias("a_key"),
            F.when(odd, listed).otherwise(F.array(F.nullif(e["one"], F.lit("")))).alias("urls"),
            odd.alias("is_odd"),
            F.when(odd, va.dump(e["citation"])).alias("raw_citation"),
            F.when(odd, va.describe(e["citation"])).alias("kind"),
        )

    typed = parts.select(
        *ids, "run_key", "has_entries", "entries",
        run_index(F.col("run_key")).alias("run_id"),
        F.coalesce(va.only_string(F.col("said")), F.lit("")).alias("prose"),
        F.coalesce(prose.last_of_each(their_pairs), F.array()).alias("theirs"),
        entry_list.isNotNull().alias("is_list"),
        F.coalesce(F.transform(read, entry), F.array()).alias("ce"),
    )
    # Two projections, so that the second pattern runs only where the first found nothing.
    blocks = typed.withColumn("echo", prose.echo_blocks(F.col("prose"))).withColumn(
        "blocks", F.when(F.size("echo") > 0, F.col("echo")).otherwise(prose.bare_blocks(F.col("prose")))
    )
    ready = blocks.withColumns(
        {
            "seen": F.array_distinct(F.transform("blocks", lambda b: b["qnum"])),
            "their_map": F.map_from_entries(
                F.transform("theirs", lambda t: F.struct(t["qnum"].alias("k"), t["text"].alias("v")))
            ),
            "ce_map": F.map_from_entries(
                F.transform(
                    prose.last_of_each(F.filter("ce", lambda c: c["qnum"].isNotNull())),
                    lambda c: F.struct(
                        c["qnum"].alias("k"),
                        F.struct(c["answer"].alias("answer"), c["evidence"].alias("evidence")).alias("v"),
                    ),
                )
            ),
            "links": F.coalesce(prose.prose_citations(F.col("blocks")), F.array()),
        }
    )

    def row(qnum: Column, answer: Column, evidence: Column, source: Column, agree: Column) -> Column:
        other = F.element_at("ce_map", qnum)
        return F.struct(
            qnum.alias("qnum"),
            answer.alias("answer_text"),
            evidence.cast("string").alias("evidence_text"),
            other["answer"].alias("ce_answer"),
            other["evidence"].alias("ce_evidence"),
            tx.is_null_word(answer).alias("is_null"),
            source.alias("parsed_from"),
            agree.cast("boolean").alias("agree_with_dict"),
            (tx.same_text(answer) == tx.same_text(other["answer"])).alias("agree_with_ce"),
        )

    none = F.lit(None)
    from_prose = F.transform(
        "blocks",
        lambda b: row(
            b["qnum"],
            b["answer"],
            tx.strip_long(b["evidence"]),
            F.when(b["shape"] == "q_echo", "answers_text").otherwise("answers_text_bare"),
            tx.same_text(b["answer"]) == tx.same_text(F.element_at("their_map", b["qnum"])),
        ),
    )
    from_dict = F.transform(
        F.filter("theirs", lambda t: ~F.array_contains("seen", t["qnum"])),
        lambda t: row(t["qnum"], t["text"], none, F.lit("answer_dict"), none),
    )
    from_ce = F.transform(
        F.filter(
            F.map_entries("ce_map"),
            lambda e: e["value"]["answer"].isNotNull()
            & ~F.array_contains("seen", e["key"])
            & ~F.map_contains_key("their_map", e["key"]),
        ),
        lambda e: row(e["key"], e["value"]["answer"], none, F.lit("citation_evidence"), none),
    )

    def url_pairs(items: Column) -> Column:
        return F.array_distinct(F.filter(items, lambda c: c["qnum"].isNotNull() & c["url"].isNotNull()))

    dict_rows = F.flatten(
        F.transform(
            "ce",
            lambda c: F.transform(
                c["urls"],
                lambda u: F.struct(
                    c["qnum"].alias("qnum"),
                    u.alias("url"),
                    c["title"].alias("title"),
                    (F.coalesce(u, F.lit("")) == "").alias("empty_placeholder"),
                    none.cast("int").alias("char_pos"),
                ),
            ),
        )
    )
    merged = ready.select(
        *ids, "run_key", "run_id", "has_entries", "entries", "is_list", "seen", "blocks", "ce",
        F.size("theirs").alias("n_theirs"),
        F.concat(from_prose, from_dict, from_ce).alias("answers"),
        "links",
        F.when(F.col("is_list"), dict_rows).otherwise(F.array()).alias("dict_links"),
        (prose.count_citations(F.col("prose")) - F.size("links")).alias("n_stray_citations"),
        F.array_distinct(
            F.transform(F.filter("ce", lambda c: c["is_odd"] & c["qnum"].isNotNull()), lambda c: c["qnum"])
        ).alias("odd_qnums"),
    )

    def pairs(name: str) -> Column:
        return url_pairs(
            F.transform(
                name,
                lambda c: F.struct(
                    c["qnum"].alias("qnum"), F.nullif(c["url"], F.lit("")).alias("url")
                ),
            )
        )

    compared = merged.withColumns({"here": pairs("links"), "there": pairs("dict_links")}).withColumns(
        {
            "prose_only": F.array_except("here", "there"),
            "dict_only": F.array_except("there", "here"),
            "disagreed": F.transform(
                F.filter("answers", lambda a: ~F.coalesce(a["agree_with_dict"], F.lit(True))),
                lambda a: a["qnum"],
            ),
        }
    ).withColumn(
        "split_qnums",
        F.when(
            F.col("has_entries") & F.col("is_list"),
            F.sort_array(
                F.array_except(
                    F.array_union(
                        F.transform("prose_only", lambda c: c["qnum"]),
                        F.transform("dict_only", lambda c: c["qnum"]),
                    ),
                    "odd_qnums",
                )
            ),
        ).otherwise(F.array()),
    )

    def urls_of(name: str, qnum: Column) -> Column:
        mine = F.transform(F.filter(name, lambda c: c["qnum"] == qnum), lambda c: c["url"])
        return F.coalesce(F.nullif(tx.capped_list(F.sort_array(mine)), F.lit("")), F.lit("-"))

    found = F.concat(
        an.problems(
            (
                F.col("run_id").isNull(),
                an.problem("RUN_KEY_UNPARSED", F.format_string("run key %s has no index", "run_key"), F.col("run_key")),
            ),
            (
                F.size("disagreed") > 0,
                an.problem(
                    "ANSWER_PARSE_MISMATCH",
                    F.format_string(
                        "run %s: %d of %d comparable answers differ from answer_dict; Q%s",
                        "run_key", F.size("disagreed"), "n_theirs", tx.capped_list(F.col("disagreed")),
                    ),
                ),
            ),
            (
                F.col("has_entries") & ~F.col("is_list"),
                an.problem(
                    "CITATION_ENTRIES_NOT_A_LIST",
                    F.format_string("run %s: entries are %s", "run_key", va.describe(F.col("entries"))),
                ),
            ),
        ),
        F.transform(
            F.filter("ce", lambda c: c["is_odd"]),
            lambda c: an.problem(
                "CITATION_SHAPE_UNEXPECTED",
                F.format_string("run %s %s: citation is %s", F.col("run_key"), c["a_key"], c["kind"]),
                c["raw_citation"],
            ),
        ),
        F.transform(
            "split_qnums",
            lambda q: an.problem(
                "CITATION_SOURCE_MISMATCH",
                F.format_string(
                    "run %s Q%d: prose only %s; dict only %s",
                    F.col("run_key"), q, urls_of("prose_only", q), urls_of("dict_only", q),
                ),
            ),
        ),
    )
    # A field first, as above: the shape looks at the stripped evidence several times.
    bare = F.transform(
        "blocks", lambda b: F.struct(b["shape"].alias("shape"), tx.strip_long(b["evidence"]).alias("evidence"))
    )
    shapes = F.transform(
        bare, lambda b: F.struct(b["shape"].alias("shape"), tx.evidence_shape(b["evidence"]).alias("evidence"))
    )
    return compared.select(
        *ids, "run_key", "run_id", "seen", "answers",
        F.transform("links", lambda c: c.withField("source", F.lit("markdown_prose"))).alias("links"),
        F.transform("dict_links", lambda c: c.withField("source", F.lit("citation_evidence"))).alias("dict_links"),
        "n_stray_citations", shapes.alias("blocks"), F.size("split_qnums").alias("n_split"),
        F.size("disagreed").alias("n_disagreed"), found.alias("problems"),
    )


# --- facts ---------------------------------------------------------------------------------


def output_records(records: DataFrame) -> DataFrame:
    """One row per record; both copies of a repeated entity stay, flagged."""
    rows = records.filter("is_record").select(
        "output_id", "se10", "n_runs", "n_answer_runs", "question_system_prompt",
        "question_user_prompt", "raw_json_hash", "questions", "empty_voted_final",
        *[f"own_{k}" for k in REPEATED_FIELDS], *ORDER,
    )
    repeated = (
        rows.groupBy("se10").agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1").select("se10")
    )
    flagged = spread_join(rows, repeated.withColumn("dup_flag", F.lit(True)), ["se10"], "left", ORDER)
    return flagged.withColumn("dup_flag", F.coalesce("dup_flag", F.lit(False)))


def answers(runs: DataFrame) -> DataFrame:
    """One row per record, run and question, with where the answer came from."""
    return runs.select(
        "se10", "output_id", "run_key", "run_id", F.posexplode("answers").alias("ord", "a"), *ORDER
    ).select("se10", "output_id", "run_key", "run_id", "ord", "a.*", *ORDER)


def citations(runs: DataFrame) -> DataFrame:
    """Links of both sources, empty placeholders included."""
    return runs.select(
        "se10", "output_id", "run_key", "run_id", F.explode(F.concat("links", "dict_links")).alias("c"), *ORDER
    ).select(
        "se10", "output_id", "run_key", "run_id", "c.*", tx.hostname(F.col("c.url")).alias("domain"), *ORDER
    )


def votes(records: DataFrame) -> DataFrame:
    """One row per record and answer key."""
    return records.filter("is_record").select(
        "se10", "output_id", F.explode("votes").alias("x"), *ORDER
    ).select("se10", "output_id", "x.*", *ORDER)


def canonical(records: DataFrame) -> DataFrame:
    """The first record that has questions: its place and its questions. At most one row."""
    return (
        records.filter("is_record and size(questions) > 0")
        .select(F.struct(*ORDER).alias("seed"), "questions")
        .orderBy("seed")
        .limit(1)
    )


def questions(records: DataFrame) -> DataFrame:
    """The canonical questions."""
    return canonical(records).select(F.inline("questions"))


def _with_canonical(df: DataFrame, records: DataFrame) -> DataFrame:
    """Attach the canonical numbers and seed as a scalar subquery: one value, no join."""
    return df.withColumn(
        "canon", canonical(records).select(F.struct("seed", "questions")).scalar()
    )


def _numbers(column: str) -> Column:
    return F.transform(column, lambda q: q["qnum"])


def question_drift(records: DataFrame) -> DataFrame:
    """Records with questions: numbers missing and added, and whether any text differs."""
    rows = _with_canonical(
        records.filter("is_record and size(questions) > 0").select("se10", "output_id", *ORDER, "questions"),
        records,
    )
    theirs = _numbers("canon.questions")
    return rows.filter(F.struct(*ORDER) > F.col("canon.seed")).select(
        "se10", "output_id", *ORDER,
        F.size("canon.questions").alias("n_canonical"),
        F.array_except(theirs, _numbers("questions")).alias("missing"),
        F.array_except(_numbers("questions"), theirs).alias("added"),
        (F.sort_array("questions") != F.sort_array("canon.questions")).alias("text_varies"),
    )


def short_runs(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Runs whose prose lacks canonical questions; records before the canonical one are not judged."""
    rows = _with_canonical(runs.select("se10", *ORDER, "run_key", "seen"), records)
    missing = F.array_except(_numbers("canon.questions"), "seen")
    return (
        rows.filter(F.struct(*ORDER) >= F.col("canon.seed"))
        .select(
            "se10", *ORDER, "run_key", F.size("seen").alias("n_seen"),
            F.size("canon.questions").alias("n_canonical"), missing.alias("missing"),
        )
        .filter(F.size("missing") > 0)
    )


def duplicate_records(records: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Later records of an entity: first place, copies, and whether an earlier one is identical.

    "Earlier and identical" is a place after the first place of (entity, hash), so no list of copies is
    ever built.
    """
    rows = records.filter("is_record").select("se10", "raw_json_hash", *ORDER)
    place = F.struct(*ORDER)
    repeated = (
        rows.groupBy("se10")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_copies"))
        .filter("n_copies > 1")
    )
    same = (
        rows.groupBy("se10", "raw_json_hash")
        .agg(F.min(place).alias("first_same"), F.count(F.lit(1)).alias("n_same"))
        .filter("n_same > 1")
        .drop("n_same")
    )
    later = spread_join(rows, repeated, ["se10"], "inner", ORDER, min_hot).filter(place > F.col("first"))
    return spread_join(later, same, ["se10", "raw_json_hash"], "left", ORDER, min_hot).withColumn(
        "identical", F.coalesce(place > F.col("first_same"), F.lit(False))
    )


def field_conflicts(output: DataFrame, merchants: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Records against the entity table: fields that differ, and whether the entity is known."""
    known = merchants.select(
        "se10", F.lit(True).alias("has_input"), *[F.col(c).alias(f"in_{c}") for c in REPEATED_FIELDS.values()]
    )
    rows = output.select("se10", "output_id", *ORDER, *[f"own_{k}" for k in REPEATED_FIELDS])
    joined = spread_join(rows, known, ["se10"], "left", ORDER, min_hot)
    clashes = F.array_compact(
        F.array(
            *[
                F.when(
                    tx.same_text(F.col(f"own_{k}")) != tx.same_text(F.col(f"in_{c}")),
                    F.concat(
                        F.lit(f"{k}: input="), F.col(f"in_{c}"), F.lit(" output="), F.col(f"own_{k}")
                    ),
                )
                for k, c in REPEATED_FIELDS.items()
            ]
        )
    )
    return joined.select(
        "se10", "output_id", *ORDER, F.coalesce("has_input", F.lit(False)).alias("has_input"),
        clashes.alias("clashes"),
    )


def anomalies(
    records: DataFrame, runs: DataFrame, merchants: DataFrame, min_hot: int = HOT_ROWS
) -> DataFrame:
    """Everything that was wrong in the output records."""
    drift = question_drift(records).filter("size(missing) > 0 or size(added) > 0")
    clashing = field_conflicts(output_records(records), merchants, min_hot).filter("size(clashes) > 0")

    def numbers(name: str) -> Column:
        return F.coalesce(F.nullif(tx.capped_list(F.sort_array(name)), F.lit("")), F.lit("-"))

    lines = records.withColumn("se10", F.when(F.col("is_record"), F.col("se10")))
    return an.union_all(
        [
            an.from_problems(lines, STAGE),
            an.from_problems(runs, STAGE, base=an.run_number(F.col("run_key")) + 100),
            an.anomaly(
                short_runs(runs, records), STAGE, "ANSWER_BLOCK_COUNT",
                F.format_string(
                    "run %s: %d of %d expected answer blocks; missing Q%s",
                    "run_key", "n_seen", "n_canonical", numbers("missing"),
                ),
                seq=an.run_number(F.col("run_key")),
            ),
            an.anomaly(
                drift, STAGE, "QUESTION_SET_DRIFT",
                F.format_string(
                    "question numbers differ from the canonical %d: missing Q%s, extra Q%s",
                    "n_canonical", numbers("missing"), numbers("added"),
                ),
            ),
            an.anomaly(
                duplicate_records(records, min_hot), STAGE, "DUP_OUTPUT_SE10",
                F.format_string(
                    "se10 %s first seen at %s:%d, %d records in all; an earlier one is %s",
                    "se10", "first.src_file", "first.src_line", "n_copies",
                    F.when(F.col("identical"), "identical").otherwise("DIFFERENT"),
                ),
            ),
            an.anomaly(
                clashing, STAGE, "INPUT_OUTPUT_FIELD_CONFLICT",
                F.concat(F.lit("input is kept; output differs on "), F.array_join("clashes", "; ")),
            ),
        ]
    )
