import json
import os
import zipfile

import pytest
from support import rows
from pyspark.sql import functions as F

from askledger.operators import masking
from askledger.operators.usage import rates_table
from askledger.plans import pipeline
from askledger.sources import lines as ln
from askledger.sources import tables
from askledger.sources.archives import holds
from askledger.streaming import resume


def log_line(se10, run=0, query="Acme Shop reviews"):
    return json.dumps({se10: {f"run_{run}": {
        "usage_metadata": {"service_tier": "standard", "input_tokens": 10, "output_tokens": 2, "total_tokens": 12, "cache_read": 4, "reasoning": 1},
        "web_search_calls": [{"id": "c", "status": "completed", "action_type": "search", "query": query, "queries": [query, "more"]}],
    }}})


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "data"
    for folder in ln.KINDS.values():
        (root / folder).mkdir(parents=True)
    (root / "logs/jsonl/b.jsonl").write_text("\n".join([log_line("1"), "", log_line("2"), "{bad"]) + "\n")
    (root / "logs/jsonl/a.jsonl").write_bytes(log_line("3").encode() + b"\r\n" + b'{"4": {"run_0": {"web_search_calls": [{"action_type": "search", "query": "\xff"}]}}}')
    (root / "logs/jsonl/skip.txt").write_text("no")
    (root / "input/m.jsonl").write_text(json.dumps({"se10": "1", "se_toc_name": "Acme Shop", "website": "w"}) + "\n")
    prose = "Q1. a\nA1. 3\nEvidence. x ([t](https://h/1))\n\nQ2. b\nA2. NULL"
    (root / "output/o.jsonl").write_text(json.dumps({
        "se10": "1", "n_runs": 1, "questions": [["s", "Q1. a\nQ2. b"]], "answer": {"run_0": prose},
        "answer_dict": {"run_0": {"A1": "3"}, "voted_majority": {"A1": "3"}, "voted_final": {"A1": "3"}},
        "citation_evidence": {"run_0": [{"a_key": "A1", "answer": "3", "citation": "https://h/1"}]}, "website": "w",
    }))
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("x/logs/jsonl/m.jsonl", log_line("9") + "\n" + log_line("1") + "\n")
        z.writestr("x/myinput/n.jsonl", "{}\n")
    return root


def test_archive_members():
    assert holds("a/logs/jsonl/f.jsonl", "logs/jsonl") and holds("f.jsonl", "input")
    assert not holds("myinput/f.jsonl", "input") and not holds("logs/x/jsonl/f.jsonl", "logs/jsonl")


def test_read_lines(spark, corpus):
    got = rows(ln.read_lines(spark, str(corpus), "weblog"), "src_rank", "src_file", "src_line", "is_damaged")
    assert got == [
        (0, "z.zip!x/logs/jsonl/m.jsonl", 1, False), (0, "z.zip!x/logs/jsonl/m.jsonl", 2, False),
        (1, "logs/jsonl/a.jsonl", 1, False), (1, "logs/jsonl/a.jsonl", 2, True),
        (1, "logs/jsonl/b.jsonl", 1, False), (1, "logs/jsonl/b.jsonl", 2, False), (1, "logs/jsonl/b.jsonl", 3, False),
        (1, "logs/jsonl/b.jsonl", 4, False),
    ]
    assert ln.read_lines(spark, str(corpus / "none"), "input").count() == 0


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "input").mkdir()
    for name, n in (("a", 3000), ("b", 1111)):
        (tmp_path / f"input/{name}.jsonl").write_text("".join(f"{i + 1} {'x' * (i % 37)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = ln.read_lines(spark, str(tmp_path), "input", archives=False)
        wrong = df.filter(F.split("raw", " ")[0].cast("bigint") != F.col("src_line")).count()
        assert (df.count(), wrong) == (4111, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_resume_and_redo(spark, corpus, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    first = resume.ingest_available(spark, str(corpus), out, checkpoint, files_per_batch=1).first()
    assert (first.seen, first.skipped) == (5, 0)
    before = rows(resume.read_bronze(spark, out), "src_file", "src_line", "raw")
    again = resume.ingest_available(spark, str(corpus), out, checkpoint).first()
    assert (again.seen, again.skipped) == (5, 5)
    assert rows(resume.read_bronze(spark, out), "src_file", "src_line", "raw") == before
    (corpus / "logs/jsonl/c.jsonl").write_text(log_line("8") + "\n")
    (corpus / "logs/jsonl/b.jsonl").write_text(log_line("1") + "\n")
    assert tuple(resume.ingest_available(spark, str(corpus), out, checkpoint).first()) == (6, 5)
    assert resume.read_bronze(spark, out).filter("src_file = 'logs/jsonl/b.jsonl'").count() == 4
    resume.redo_files(spark, str(corpus), out, ["logs/jsonl/b.jsonl"])
    bronze = resume.read_bronze(spark, out)
    assert bronze.filter("src_file = 'logs/jsonl/b.jsonl'").count() == 1 and bronze.count() == len(before) + 1 - 3
    (corpus / "logs/jsonl/b.jsonl").write_text("")
    resume.redo_files(spark, str(corpus), out, ["logs/jsonl/b.jsonl"])
    assert resume.read_bronze(spark, out).filter("src_file = 'logs/jsonl/b.jsonl'").count() == 0
    noted = resume.ingested_files(spark, out).filter("src_file = 'logs/jsonl/b.jsonl'")
    assert rows(noted, "kind", "n_lines") == [("weblog", 0)] and resume.ingested_files(spark, out).count() == 6


def test_batch_ingest_agrees_with_stream(spark, corpus, tmp_path):
    resume.ingest_batch(spark, str(corpus), str(tmp_path / "a"))
    resume.ingest_available(spark, str(corpus), str(tmp_path / "b"), str(tmp_path / "cp"))
    columns = ln.COLUMNS
    a = rows(resume.read_bronze(spark, str(tmp_path / "a")), *columns)
    assert a == rows(resume.read_bronze(spark, str(tmp_path / "b")), *columns) and len(a) == 10


def test_groups_and_exports(spark, tmp_path):
    path = tmp_path / "groups.csv"
    assert tables.read_groups(spark, str(path)).count() == 0
    path.write_text('template,archetype\n"<NAME>, x",old\n"<NAME>, x",new\n,no\nblank,\n')
    assert rows(tables.read_groups(spark, str(path))) == [("<NAME>, x", "new")]
    q = spark.createDataFrame(
        [("1", True, "raw", 0, None), ("1", True, '<NAME> "x"', 1, None)],
        "se10 string, is_billed_query boolean, template string, n_placeholders int, archetype string",
    )
    assert rows(tables.export_head(q, str(tmp_path / "head"))) == [(1, 1)]


def test_pipeline_end_to_end(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    resume.ingest_batch(spark, str(corpus), out)
    t = pipeline.build_tables(spark, out)
    assert rows(t["runs"], "se10", "src_file") == [
        ("1", "z.zip!x/logs/jsonl/m.jsonl"), ("2", "logs/jsonl/b.jsonl"), ("3", "logs/jsonl/a.jsonl"),
        ("4", "logs/jsonl/a.jsonl"), ("9", "z.zip!x/logs/jsonl/m.jsonl"),
    ]
    assert rows(t["anomalies"].groupBy("code").count()) == [
        ("BAD_JSON_LINE", 1), ("DUP_RUN", 1), ("ENCODING", 1), ("MISSING_USAGE_METADATA", 1),
    ]
    groups = spark.createDataFrame([("<NAME> reviews", "reviews"), ("gone", "g")], "template string, archetype string")
    for _ in range(2):  # running again replaces, it does not add
        masked = pipeline.mask(spark, out, groups)
    assert masked.filter("archetype = 'reviews'").count() == 2
    found = spark.read.parquet(f"{out}/anomalies")
    assert rows(found.filter("stage = 'analyze'").groupBy("code").count()) == [
        ("ARCHETYPE_GROUP_UNMATCHED", 1), ("TEMPLATE_NO_PII_TERMS", 4)
    ]
    cured = spark.createDataFrame([("<NAME> reviews", "reviews")], "template string, archetype string")
    pipeline.mask(spark, out, cured)  # the group nothing matched is gone, and so is its anomaly
    found = spark.read.parquet(f"{out}/anomalies")
    assert rows(found.filter("stage = 'analyze'").groupBy("code").count()) == [("TEMPLATE_NO_PII_TERMS", 4)]
    tables.replace_stages(found.filter("stage = 'none'"), f"{out}/anomalies", ["analyze"])
    assert spark.read.parquet(f"{out}/anomalies").filter("stage = 'analyze'").count() == 0
    masked = pipeline.mask(spark, out, groups)
    t = dict(tables.read_tables(spark, out, pipeline.TABLES))
    reports = pipeline.reports(t, masked, rates_table(spark, {"standard": {}}))
    for name, df in reports.items():
        assert df.limit(5).collect() is not None, name
    assert reports["scorecard"].count() == 2
    # no report prints a value of an entity's record
    shown = " ".join(str(r) for r in reports["health"].collect())
    assert "Acme" not in shown
    before = rows(t["search_calls"], "se10", "call_index", "raw_json")
    assert rows(pipeline.reparse(spark, out), "se10", "call_index", "raw_json") == before
    assert "template" not in spark.read.parquet(f"{out}/query_instances").columns
    assert not os.path.exists(f"{out}/masked_queries")
    assert spark.read.parquet(f"{out}/anomalies").filter("stage = 'analyze'").count() == 0


def test_masked_text_holds_no_live_term(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    resume.ingest_batch(spark, str(corpus), out)
    t = pipeline.build_tables(spark, out)
    masked = masking.mask_queries(
        t["query_instances"], t["terms"], spark.createDataFrame([], tables.GROUPS_SCHEMA), pipeline.QUERY_KEY
    )
    left = masked.join(t["terms"], "se10").filter(F.contains("template", "value_norm"))
    assert left.count() == 0 and masked.count() == t["query_instances"].count()


def test_parts_follow_the_rows_of_a_table(spark, tmp_path):
    """A task parses so many rows, not a share of the table."""
    from askledger.plans import binding

    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    spread = binding.spread_table(spark, str(tmp_path), "t", part_rows=10)
    assert spread.rdd.getNumPartitions() == 100 and spread.count() == 1000


def test_parts_follow_the_rows_of_splits_not_their_bytes(spark, tmp_path):
    """A file of one row group is split by bytes, but one split reads all its rows: they are dealt all the same."""
    from askledger.plans import binding

    path = tmp_path / "t.parquet"
    spark.range(2000).selectExpr("id", "repeat(sha2(cast(id as string), 256), 4) as text").coalesce(1).write.parquet(str(path))
    spark.range(2000).repartition(20).write.parquet(str(tmp_path / "even.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in kept:
            spark.conf.set(key, 4096)
        assert spark.read.parquet(str(path)).rdd.getNumPartitions() >= 20
        for name, dealt in (("t", True), ("even", False)):
            spread = binding.spread_table(spark, str(tmp_path), name, part_rows=100)
            sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 2000 and max(sizes) <= 200
            assert ("Exchange" in spread._jdf.queryExecution().executedPlan().toString()) == dealt
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
