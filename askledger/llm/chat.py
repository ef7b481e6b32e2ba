"""Tool calls in conversations: linked with their results, ordered by dependency, checked and serialised. DataFrame
functions only.

Input is a table of calls (conv_id, call_id, position, name, arguments as JSON text, depends_on) and one of results
(conv_id, call_id, position, content). Results are reduced to one row per identifier, the first by (position, content)
plus a count, before they meet the calls in an equi-join; nothing else is gathered by conversation, so a conversation of
any length is spread like all others.

The topological level of a call is 0 without dependencies, else one more than the highest among them. Calls with
one dependency form chains, whose lengths are found by doubling, in as many rounds as the length has binary digits; calls
with several are resolved in rounds after that, as many as such calls follow one another. Rounds go over rows of two
identifiers and are checkpointed. (level, position, call_id) is the order of a conversation's calls.

Canonical JSON has no spaces, sorts the keys of every object and leaves null fields out.

Defined results: a call with a null id is linked with nothing and has no level (`no_id`). Of several calls of one id the
first by (position, name, arguments) is the call; the others are kept as `repeated` and not linked. Results without a call
become rows of status `orphan`; results with a null id are orphans too. Arguments that are null or no JSON object are an
error. Dependencies on unknown ids or on the call itself are errors and do not count; calls on a cycle, and those that
wait for one, have no level and the error `cycle`. Exact repeats of rows count once. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askledger.llm.common import shared_folder

CALL_COLUMNS = ("conv_id", "call_id", "position", "name", "arguments", "depends_on")
#: Types a schema can ask for, and what the variant type names of such values begin with.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}

Schemas = dict[str, dict[str, tuple[str, bool]]]


def canonical(json: Column) -> Column:
    """Canonical form of JSON text: objects of the variant type hold their keys in order."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted messages about arguments that do not fit the schema of their tool."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    known = reduce(lambda a, b: a | b, [name == t for t in schemas], F.lit(False))
    none = F.array().cast("array<string>")

    def of(tool: str) -> Column:
        checks = []
        for key, (kind, required) in sorted(schemas[tool].items()):
            there = F.array_contains(keys, key)
            found = F.schema_of_variant(F.variant_get(value, f"$['{key}']", "variant"))
            fits = reduce(lambda a, b: a | b, [found.startswith(t) for t in TYPES[kind]])
            wrong = F.when(there & ~F.coalesce(fits, F.lit(False)), F.lit(f"{key} is not of type {kind}"))
            checks.append(F.when(~there, F.lit(f"{key} is missing")).otherwise(wrong) if required else wrong)
        spare = F.transform(F.filter(keys, lambda k: ~k.isin(*schemas[tool])), lambda k: F.concat(k, F.lit(" is not known")))
        return F.concat(F.array_compact(F.array(*checks)), spare)

    fitting = reduce(lambda out, t: F.when(name == t, of(t)).otherwise(out), schemas, none)
    unread = F.array(F.lit("arguments are not an object"))
    unknown = F.array(F.concat(F.lit("no such tool: "), F.coalesce(name, F.lit("null"))))
    return F.array_sort(F.when(keys.isNull(), unread).when(~F.coalesce(known, F.lit(False)), unknown).otherwise(fitting))


def _chains(single: DataFrame) -> DataFrame:
    """call_id, to, away: where a chain of calls with one dependency each ends, and how many steps away.

    Every round doubles the steps. A call that still moves after more steps than there are calls is caught in a cycle.
    """
    jump = single.select("call_id", F.col("on").alias("to"), F.lit(1).cast("long").alias("away"), F.lit(True).alias("moved")).checkpoint()
    reach, calls = 1, jump.count()
    while reach <= 2 * calls and not jump.where("moved").isEmpty():
        further = jump.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("away").alias("more"))
        jump = jump.join(further, "to", "left").select(
            "call_id", F.coalesce("next", "to").alias("to"), (F.col("away") + F.coalesce("more", F.lit(0))).alias("away"), F.col("next").isNotNull().alias("moved")
        ).checkpoint()
        reach *= 2
    return jump.where("NOT moved").drop("moved")


def levels(ids: DataFrame, needs: DataFrame) -> DataFrame:
    """call_id, level: null for calls on a cycle or behind one. `needs` (call_id, on) names existing calls only.

    Calls with one dependency form chains, measured by doubling; what stays are calls with several dependencies. They are
    resolved in rounds, each taking those whose chains all end at resolved calls.
    """
    spark = ids.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    needs = needs.distinct().checkpoint()
    degree = needs.groupBy("call_id").agg(F.count("*").alias("n"), F.min("on").alias("on"))
    chain = _chains(degree.where("n = 1").select("call_id", "on"))
    roots = ids.select("call_id").join(degree.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))
    single = degree.where("n = 1").select("call_id")
    several = needs.join(degree.where("n > 1").select("call_id"), "call_id", "left_semi")
    ends = (
        several.join(chain.withColumnRenamed("call_id", "on"), "on", "left")
        .join(single.select(F.col("call_id").alias("on"), F.lit(True).alias("is_single")), "on", "left")
        # a chain without an end leads into a cycle: a place no call has keeps it open
        .select("call_id", F.when(F.col("is_single") & F.col("to").isNull(), F.lit(None)).otherwise(F.coalesce("to", "on")).alias("to"), F.coalesce("away", F.lit(0)).alias("away"))
    )
    open_ = ends.checkpoint()
    done = roots.checkpoint()
    fresh = done
    while not open_.isEmpty() and not fresh.isEmpty():
        met = open_.join(done.select(F.col("call_id").alias("to"), "level"), "to", "left")
        ready = met.groupBy("call_id").agg(F.count("*").alias("n"), F.count("level").alias("met"), (F.max(F.col("level") + F.col("away")) + 1).alias("level"))
        fresh = ready.where("n = met").select("call_id", "level").checkpoint()
        done = done.union(fresh).checkpoint()
        open_ = open_.join(fresh.select("call_id"), "call_id", "left_anti").checkpoint()
    along = chain.join(done.select(F.col("call_id").alias("to"), "level"), "to").select("call_id", (F.col("level") + F.col("away")).alias("level"))
    known = done.union(along)
    return ids.select("call_id").join(known, "call_id", "left").select("call_id", F.col("level").cast("int"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, status, level, position, valid, errors, n_results, record (canonical JSON)."""
    calls = calls.select(*CALL_COLUMNS).distinct()
    place = F.struct("position", "name", "arguments")
    first = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(place).alias("first"))
    known = calls.join(first, "call_id", "left")
    known = known.withColumn("is_first", F.col("call_id").isNotNull() & place.eqNullSafe(F.col("first"))).drop("first")

    wanted = known.where("is_first").select("call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    there = first.select(F.col("call_id").alias("on"), F.lit(True).alias("there"))
    judged = wanted.join(there, "on", "left").withColumn("good", F.col("there").isNotNull() & (F.col("on") != F.col("call_id")))
    level = levels(first.select("call_id"), judged.where("good").select("call_id", "on"))
    bad = judged.where("NOT good").groupBy("call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("cannot depend on "), "on"))).alias("bad"))

    answers = results.select("conv_id", "call_id", "position", "content").distinct()
    answered = answers.groupBy("call_id").agg(F.min(F.struct("position", "content", "conv_id")).alias("answer"), F.count("*").alias("n_results"))
    linked = known.where("is_first").join(level, "call_id", "left").join(bad, "call_id", "left").join(answered, "call_id", "full")

    arguments = argument_errors(F.col("name"), F.col("arguments"), schemas)
    none = F.array().cast("array<string>")
    errors = F.concat(arguments, F.coalesce("bad", none), F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none))
    called = F.col("is_first").isNotNull()
    status = F.when(~called, "orphan").when(F.col("answer").isNotNull(), "linked").otherwise("unanswered")
    main = linked.select(
        F.when(called, F.col("conv_id")).otherwise(F.col("answer.conv_id")).alias("conv_id"), "call_id", status.alias("status"), "level",
        F.when(called, F.col("position")).otherwise(F.col("answer.position")).alias("position"), "name", "arguments", "depends_on",
        F.when(called, errors).otherwise(none).alias("errors"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("answer.content").alias("result"),
    )
    rest = known.where("NOT is_first").select(
        "conv_id", "call_id", F.when(F.col("call_id").isNull(), "no_id").otherwise("repeated").alias("status"), F.lit(None).cast("int").alias("level"),
        "position", "name", "arguments", "depends_on", arguments.alias("errors"), F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("string").alias("result"),
    )
    every = main.unionByName(rest)
    fields = F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id"), F.when(F.size("depends_on") > 0, F.array_sort(F.array_distinct("depends_on"))).alias("depends_on"),
        F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), "level", "name", "result", "status",
    )
    return every.select("conv_id", "call_id", "status", "level", "position", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), "n_results", F.to_json(fields).alias("record"))


#: The tools of the derived conversations: parameter -> type, whether it is required.
TOOLS: Schemas = {
    "search": {"text": ("string", True), "chars": ("integer", True), "after": ("string", False)},
    "lookup": {"text": ("string", True), "chars": ("integer", False), "after": ("string", False)},
    "summarise": {"text": ("string", True), "chars": ("number", True)},
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read user turns as calls and assistant turns as results of the turn before; turns of other roles are `messages`.
    Some calls get a wrong type or a parameter that their tool does not know, by rules on their ids; one without a text
    lacks a parameter."""
    turn, conv = F.col("turn"), F.col("conv_id")
    name = lambda t: F.concat(F.lit("c"), conv, F.lit("."), t)
    chars = F.length("text")
    before = F.when((turn >= 2) & (conv % 2 == 0), name(turn - 2))
    wrong = F.pmod(turn + conv, F.lit(7)) == 3
    arguments = F.when(
        wrong, F.to_json(F.struct("text", chars.cast("string").alias("chars"), before.alias("after")))
    ).otherwise(F.to_json(F.struct("text", chars.alias("chars"), before.alias("after"))))
    tool = F.element_at(F.array(*[F.lit(t) for t in ("search", "lookup", "summarise")]), (F.pmod(conv + turn, F.lit(3)) + 1).cast("int"))
    calls = conversations.where("role = 'user'").select(
        "conv_id", name(turn).alias("call_id"), turn.alias("position"), tool.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(before)).alias("depends_on")
    )
    results = conversations.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return calls, results


def messages(conversations: DataFrame) -> DataFrame:
    """Turns that are neither call nor result (role system, tool, unknown or null), in the columns of `link`: status
    `message`, no identifier, no level; the record has role and text. Exact repeats count once."""
    fields = F.struct(F.col("text").alias("content"), "role", F.lit("message").alias("status"))
    none = F.lit(None)
    return conversations.where("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", "text").distinct().select(
        "conv_id", none.cast("string").alias("call_id"), F.lit("message").alias("status"), none.cast("int").alias("level"), F.col("turn").alias("position"),
        F.lit(True).alias("valid"), F.lit("").alias("errors"), F.lit(0).cast("long").alias("n_results"), F.to_json(fields).alias("record"),
    )


def linked_turns(conversations: DataFrame) -> DataFrame:
    """Every turn of the conversations: calls with their results, results without a call, and messages."""
    return link(*from_conversations(conversations), TOOLS).unionByName(messages(conversations))


ORACLE_SQL = """
WITH RECURSIVE u AS (
  SELECT DISTINCT conv_id, turn, 'c' || conv_id || '.' || turn AS call_id, text, ['search', 'lookup', 'summarise'][(conv_id + turn) % 3 + 1] AS name,
    (turn + conv_id) % 7 = 3 AS wrong, text IS NOT NULL AS has_text,
    CASE WHEN turn >= 2 AND conv_id % 2 = 0 THEN 'c' || conv_id || '.' || (turn - 2) END AS after
  FROM conversations WHERE role = 'user'),
k AS (SELECT u.*, p.call_id IS NOT NULL AS known FROM u LEFT JOIN (SELECT DISTINCT call_id FROM u) p ON u.after = p.call_id),
l AS (SELECT call_id, 0 AS level FROM k WHERE after IS NULL OR NOT known
      UNION ALL SELECT k.call_id, l.level + 1 FROM k JOIN l ON k.after = l.call_id WHERE k.known),
a AS (SELECT call_id, count(*) AS n, min_by(content, turn) AS content, min(conv_id) AS conv_id, min(turn) AS turn
      FROM (SELECT DISTINCT conv_id, turn, 'c' || conv_id || '.' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant') GROUP BY 1),
e AS (SELECT k.*, l.level, list_filter([
        CASE WHEN name = 'summarise' AND after IS NOT NULL THEN 'after is not known' END,
        CASE WHEN wrong AND text IS NOT NULL THEN 'chars is not of type ' || CASE name WHEN 'summarise' THEN 'number' ELSE 'integer' END
             WHEN text IS NULL AND name <> 'lookup' THEN 'chars is missing' END,
        CASE WHEN NOT has_text THEN 'text is missing' END,
        CASE WHEN after IS NOT NULL AND NOT known THEN 'cannot depend on ' || after END], lambda x: x IS NOT NULL) AS errors
      FROM k LEFT JOIN l USING (call_id)),
j AS (SELECT coalesce(e.conv_id, a.conv_id) AS conv_id, call_id, CASE WHEN e.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status,
        e.level, coalesce(e.turn, a.turn) AS position, coalesce(len(e.errors), 0) = 0 AS valid, coalesce(array_to_string(e.errors, '; '), '') AS errors, coalesce(a.n, 0) AS n_results,
        e.name, e.after, e.has_text, e.wrong, e.text, a.content, e.errors AS list
      FROM e FULL JOIN a USING (call_id))
SELECT conv_id, call_id, status, level, position, valid, errors, n_results, '{' || array_to_string(list_filter([
    CASE WHEN status <> 'orphan' THEN '"arguments":{' || array_to_string(list_filter([
      CASE WHEN after IS NOT NULL THEN '"after":"' || after || '"' END,
      CASE WHEN text IS NOT NULL THEN CASE WHEN wrong THEN '"chars":"' || length(text) || '"' ELSE '"chars":' || length(text) END END,
      CASE WHEN has_text THEN '"text":' || to_json(text) END], lambda x: x IS NOT NULL), ',') || '}' END,
    '"call_id":' || to_json(call_id), CASE WHEN after IS NOT NULL THEN '"depends_on":["' || after || '"]' END,
    CASE WHEN len(list) > 0 THEN '"errors":' || to_json(list) END, CASE WHEN level IS NOT NULL THEN '"level":' || level END,
    CASE WHEN name IS NOT NULL THEN '"name":"' || name || '"' END, CASE WHEN content IS NOT NULL THEN '"result":' || to_json(content) END,
    '"status":"' || status || '"'], lambda x: x IS NOT NULL), ',') || '}' AS record
FROM j
UNION ALL
SELECT conv_id, NULL, 'message', NULL, turn, true, '', 0, '{' || array_to_string(list_filter([
    CASE WHEN text IS NOT NULL THEN '"content":' || to_json(text) END, CASE WHEN role IS NOT NULL THEN '"role":' || to_json(role) END,
    '"status":"message"'], lambda x: x IS NOT NULL), ',') || '}'
FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
"""
