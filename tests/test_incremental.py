import glob
import json
import os
from urllib.parse import quote

import pytest
from support import rows
from test_sources import corpus, log_line  # noqa: F401

from askledger.operators import records
from askledger.plans import incremental, pipeline
from askledger.sources.tables import drop_table
from askledger.streaming import resume


def entity(se10, name="Shop", website="w"):
    return json.dumps({"se10": se10, "se_toc_name": name, "website": website})


def record(se10, website="w", questions="Q1. a\nQ2. b", said="3"):
    return json.dumps({
        "se10": se10, "n_runs": 1, "questions": [["s", questions]], "answer": {"run_0": f"Q1. a\nA1. {said}\nEvidence. x ([t](https://h/1))"},
        "answer_dict": {"run_0": {"A1": said}, "voted_majority": {"A1": said}, "voted_final": {"A1": "4"}},
        "citation_evidence": {"run_0": [{"a_key": "A1", "answer": said, "citation": "https://h/2"}]}, "website": website,
    })


def rebuilt(spark, out):
    """All tables from the parsed rows of all files at once."""
    shapes = incremental.schemas(spark)
    return pipeline.tables_of({n: incremental._read(spark, out, n, shapes[n]) for n in incremental.SHREDDED})


def assert_same(spark, out):
    kept, wanted = incremental.read_tables(spark, out), rebuilt(spark, out)
    for name in pipeline.TABLES:
        columns = [c for c in wanted[name].columns if c != "ts_recorded"]
        assert rows(kept[name], *columns) == rows(wanted[name], *columns), name


@pytest.fixture
def load(spark, corpus, tmp_path):  # noqa: F811
    """Write files (path: lines), load them, update; returns the files that were written, by kind."""
    out = str(tmp_path / "out")

    def go(files=(), redo=()):
        for path, lines in dict(files).items():
            (corpus / path).write_text("".join(f"{x}\n" for x in lines))
        resume.ingest_available(spark, str(corpus), out, str(tmp_path / "cp"))
        resume.redo_files(spark, str(corpus), out, list(redo))
        return incremental.update(spark, out)

    go.out = out
    return go


def test_updates_equal_a_rebuild(spark, corpus, load):  # noqa: F811
    load()
    assert not any(incremental.update(spark, load.out).values())
    # a log file that comes first and takes runs over, copies of entities and records, a record that its entity contradicts
    done = load({
        "logs/jsonl/0.jsonl": [log_line("3", query="other"), "{bad"], "logs/jsonl/c.jsonl": [log_line("1", 1)],
        "input/n.jsonl": [entity("7", website="else")], "output/p.jsonl": [record("7"), record("1"), record("8"), record("1", said="NULL")],
    })
    assert done == {
        "weblog": {"logs/jsonl/0.jsonl", "logs/jsonl/a.jsonl", "logs/jsonl/c.jsonl"}, "input": {"input/n.jsonl"}, "output": {"output/o.jsonl", "output/p.jsonl"},
    }
    # an input file that goes before the others changes which copy is kept, and what records are compared with
    assert load({"input/a.jsonl": [entity("7")]}) == {"weblog": set(), "input": {"input/a.jsonl", "input/n.jsonl"}, "output": {"output/p.jsonl"}}
    assert_same(spark, load.out)


def test_redone_emptied_and_reordered_files(spark, corpus, load):  # noqa: F811
    load({"logs/jsonl/c.jsonl": [log_line("2"), log_line("5")], "output/p.jsonl": [record("8")], "output/q.jsonl": [record("8"), record("9")]})
    # the kept copy of a run goes and the next one takes its place; a record's only copy goes; the first questions are others
    done = load({"logs/jsonl/b.jsonl": [log_line("60")], "output/q.jsonl": [], "output/a.jsonl": [record("70", questions="Q1. a\nQ2. b\nQ3. c")]}, redo=["logs/jsonl/b.jsonl", "output/q.jsonl"])
    assert {"logs/jsonl/b.jsonl", "logs/jsonl/c.jsonl"} <= done["weblog"] and "logs/jsonl/a.jsonl" not in done["weblog"]
    assert done["output"] == {"output/a.jsonl", "output/o.jsonl", "output/p.jsonl", "output/q.jsonl"}
    assert incremental.read_tables(spark, load.out)["output_records"].filter("dup_flag").count() == 0
    assert_same(spark, load.out)


def test_an_update_cut_short_is_done_again(spark, corpus, load, monkeypatch):  # noqa: F811
    load({"logs/jsonl/c.jsonl": [log_line("2"), log_line("1")]})
    written = incremental.write_table
    monkeypatch.setattr(incremental, "write_table", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        load({"logs/jsonl/b.jsonl": [log_line("61")]}, redo=["logs/jsonl/b.jsonl"])
    # as if it had ended before the table that lost its first copy was written
    drop_table(spark, f"{load.out}/typed/runs/src_file={quote('logs/jsonl/c.jsonl', safe='')}")
    monkeypatch.setattr(incremental, "write_table", written)
    assert {"logs/jsonl/b.jsonl", "logs/jsonl/c.jsonl"} <= incremental.update(spark, load.out)["weblog"]
    assert [r.src_file for r in incremental.read_tables(spark, load.out)["runs"].filter("se10 = '2'").collect()] == ["logs/jsonl/c.jsonl"]


def test_other_files_are_not_opened(spark, corpus, load):  # noqa: F811
    load()
    spoiled = [f for name in incremental.SHREDDED for f in glob.glob(f"{load.out}/typed/{name}/src_file=*[bmo].jsonl/*.parquet")]
    assert len(spoiled) >= 4
    for file in spoiled:
        with open(file, "wb") as f:
            f.write(b"not a table")
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    done = load({"logs/jsonl/d.jsonl": [log_line("90")], "input/o.jsonl": [entity("28")]})
    assert done == {"weblog": {"logs/jsonl/d.jsonl"}, "input": {"input/o.jsonl"}, "output": set()}
    assert {"2", "90"} <= {r.se10 for r in incremental.read_tables(spark, load.out)["runs"].collect()}
