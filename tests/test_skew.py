from support import rows
from pyspark.sql import functions as F

from askledger.operators import anomaly as an
from askledger.operators import masking as mk
from askledger.operators import skew


def skewed(spark):
    """A third of all rows on one key."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )


def test_spread_join_equals_plain_join(spark):
    big = skewed(spark)
    side = big.select("k").distinct().filter("k <> 'k7'").withColumn("v", F.length("k"))
    for how in ("left", "inner"):
        mine = skew.spread_join(big, side, ["k"], how, ["id"], min_rows=100)
        assert rows(mine, "id", "k", "v") == rows(big.join(side, "k", how), "id", "k", "v")


def test_hot_key_is_cut(spark):
    hot = rows(skew.hot_keys(skewed(spark), ["k"], 100))
    assert hot == [("hot", 11)]
    assert skew.hot_keys(skewed(spark), ["k"], 10_000).count() == 0


def test_every_hot_key_is_cut(spark):
    many = spark.range(6000).select((F.col("id") % 1500).alias("k"), "id")
    assert skew.hot_keys(many, ["k"], 3).count() == 1500
    side = many.select("k").distinct().withColumn("v", F.col("k") + 1)
    assert rows(skew.spread_join(many, side, ["k"], min_rows=3), "id", "v") == rows(many.join(side, "k"), "id", "v")


def test_numbered_equals_row_number(spark):
    from pyspark.sql import Window

    df = skewed(spark)
    mine = skew.numbered(df, ["k"], "id", ["id"], width=70)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert rows(mine, "id", "rn") == rows(plain, "id", "rn")


def test_keep_first(spark):
    first = skew.keep_first(skewed(spark), ["k"], ["id"])
    assert rows(first) == rows(skewed(spark).groupBy("k").agg(F.min("id").alias("id")).select("id", "k"))


def test_payload_cap_keeps_every_row(spark):
    df = spark.range(500).select(
        F.lit("s").alias("stage"), F.lit("C").alias("code"), F.lit(None).cast("string").alias("se10"),
        F.concat(F.lit("f"), F.col("id") % 2).alias("src_file"), F.col("id").alias("src_line"),
        F.lit("x").alias("raw_excerpt"), F.lit(None).cast("string").alias("context"),
        F.lit("d").alias("detail"), F.current_timestamp().alias("ts_recorded"), F.lit(0).cast("bigint").alias("seq"),
    )
    assert an.cap_payload(df).filter("raw_excerpt is not null").count() == 500
    capped = an.cap_payload(df, rows=10, width=37)
    assert capped.count() == 500
    kept = capped.filter("raw_excerpt is not null")
    assert rows(kept.groupBy("src_file").agg(F.count("*"), F.max("src_line"))) == [("f0", 10, 18), ("f1", 10, 19)]


def test_samples_prefer_text_and_spread_over_files(spark):
    data = [("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("b", 1, "x"), ("b", 2, None)]
    df = spark.createDataFrame(
        [("s", "C", None, f, n, x, None, "d", None, 0) for f, n, x in data], an.SCHEMA
    )
    got = an.anomaly_samples(df, "C", 3, width=2).collect()
    assert [(r.src_file, r.src_line) for r in got] == [("b", 1), ("a", 2), ("a", 3)]


def brute_mask(text, terms):
    n = 0
    for field, value in sorted(terms, key=lambda t: (-len(t[1]), t[1], t[0])):
        n += text.count(value)
        text = text.replace(value, f"<{field.upper()}>")
    return text, n


def test_masking_agrees_with_brute_force_for_wide_and_hot_entities(spark):
    words = [f"w{i:03d}" for i in range(300)]
    terms = {"hot": [("name" if i % 2 else "city", w) for i, w in enumerate(words)],
             "small": [("name", "acme"), ("street", "acme road")], "none": []}
    texts = [f"{words[i % 300]} and {words[(7 * i) % 300]} acme road acme {i}" for i in range(400)]
    queries = [(("hot", "small", "none")[0 if i % 3 else 1 + i % 2], i, t) for i, t in enumerate(texts)]
    q = spark.createDataFrame(queries, "se10 string, q_ord int, query_text string").withColumn(
        "is_billed_query", F.lit(True)
    )
    t = spark.createDataFrame(
        [(e, f, v) for e, ts in terms.items() for f, v in ts], "se10 string, field string, value_norm string"
    )
    groups = spark.createDataFrame([], "template string, archetype string")
    masked = mk.mask_queries(q, t, groups, ["se10", "q_ord"], limit=16)
    got = {(r.se10, r.q_ord): (r.template, r.n_placeholders, r.has_terms) for r in masked.collect()}
    assert len(got) == len(queries)
    for e, i, text in queries:
        assert got[e, i] == (*brute_mask(text, terms[e]), bool(terms[e]))


def test_queries_are_scanned_and_shuffled_once_for_masking(spark, tmp_path):
    q = spark.range(100).selectExpr("cast(id % 7 as string) se10", "cast(id as int) q_ord", "'a b' query_text", "true is_billed_query")
    q.write.parquet(f"{tmp_path}/q")
    t = spark.createDataFrame([("1", "name", "a")], "se10 string, field string, value_norm string")
    masked = mk.mask_queries(spark.read.parquet(f"{tmp_path}/q"), t, spark.createDataFrame([], "template string, archetype string"), ["se10", "q_ord"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = masked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reads = [line for line in plan.splitlines() if "FileScan parquet" in line and "q_ord" in line]
    assert len(reads) <= 2 and ("ReusedExchange" in plan or "Broadcast" in plan)


def test_queries_meet_terms_that_are_packed_already(spark):
    """The join has no packing in its tasks, and the parts of a large entity give the same hits as one row."""
    queries = spark.createDataFrame([("a", 1, "Ann of Oak Street"), ("b", 2, "oak"), (None, 3, "ann")], "se10 string, k int, q string")
    terms = spark.createDataFrame([("a", "name", "ann"), ("a", "street", "oak street"), ("a", "city", "rome"), (None, "name", "ann")], "se10 string, field string, value_norm string")
    for limit in (2, 100):
        found = mk.attach_hits(queries, terms, F.lower("q"), ["k"], limit)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "count(" not in plan
        got = {r.k: ([h.value_norm for h in r._hits], r._has_terms) for r in found.collect()}
        assert got == {1: (["oak street", "ann"], True), 2: ([], False), 3: ([], False)}


def test_partitions_are_bounded(spark):
    """Many partitions to start with, merged up to a fixed size: a task's memory does not follow the input."""
    from askledger.session import ADVISED

    assert ADVISED["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "16m"
    assert int(ADVISED["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 1000


def test_sides_are_not_shuffled_to_meet_the_hot_keys(spark):
    big = skewed(spark)
    side = big.select("k").distinct()
    # rows of `big` move once, by key and piece: the few hot keys come to them
    plan = skew.spread_join(big, side, ["k"], "left", ["id"], min_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
