import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askledger.functions import prose
from askledger.functions import text as tx


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_forms(spark):
    assert column(spark, [" A  b\n", "Straße", None], tx.same_text) == ["a b", "strasse", None]
    assert column(spark, ['"O\'Brien & Co.", ', "(555) 1"], tx.term_text) == ["o'brien & co", "555) 1"]
    assert column(spark, ['"MARIANNA" "City, CA"', "“a”;b"], tx.query_text) == ["marianna city ca", "a b"]


def test_null_word_and_shapes(spark):
    assert column(spark, [" null\n", "NULL", "nul", None], tx.is_null_word) == [True, True, False, False]
    shapes = column(spark, [None, "  ", " Null ", "\n", "x"], tx.evidence_shape)
    assert shapes == ["absent", "empty", "null", "present", "present"]
    assert column(spark, ["\n"], tx.block_evidence_shape) == ["empty"]


def test_scale(spark):
    values = ["3", "3 - no\nmedia", "35", "6", "33", "x3"]
    assert column(spark, values, tx.is_scale) == [True, True, False, False, False, False]
    assert column(spark, ["3", "3x", "31", "4"], tx.is_three) == [True, True, False, False]


def test_hostname(spark):
    urls = [
        "https://User:pw@WWW.Example.com:80/a", "http://[::1]:8/x", "//h.example?q", "plain", "", None,
        "mailto:a@b", "https://a.example#f",
    ]
    assert column(spark, urls, tx.hostname) == [
        "www.example.com", "::1", "h.example", None, None, None, None, "a.example"
    ]


def test_capped_list(spark):
    got = column(spark, ["x"], lambda _: tx.capped_list(F.sequence(F.lit(1), F.lit(14))))
    assert got == [", ".join(map(str, range(1, 15)))]
    got = column(spark, ["x"], lambda _: tx.capped_list(F.sequence(F.lit(1), F.lit(14)), 12))
    assert got == ["1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, ... (+2 more)"]


def blocks(spark, texts):
    return [[tuple(b) for b in r] for r in column(spark, texts, prose.answer_blocks)]


def test_block_shapes(spark):
    got = blocks(
        spark,
        [
            "Q1. text\nA1. 2\nEvidence. seen ([t](https://a.example/1))\n\nQ2. text\nA2. NULL",
            "Q1. text\nA1. 4\nEvidence.",
            "A1. 5\nA2. NULL\nA3. 3",
            "prose without any answer",
        ],
    )
    assert got[0][0][:3] == (1, "2", "seen ([t](https://a.example/1))")
    assert got[0][1] == (2, "NULL", None, None, "q_echo")
    assert got[1][0][2] == ""
    assert [b[:2] for b in got[2]] == [(1, "5"), (2, "NULL"), (3, "3")] and got[2][0][4] == "bare"
    assert got[3] == []


def test_bare_shape_never_rereads_echoed_text(spark):
    (only,) = blocks(spark, ["Q1. q\nA1. 2\n\nA9. stray"])
    assert [b[4] for b in only] == ["q_echo"]


PIECES = st.sampled_from(
    ["Q1. q", "Q2. é", "\nA1. 3", "\nA2. NULL", "\n\n", "\n", "\nEvidence. ", "\nEvidence", "x ([t](u))", "([]())", " ", "A3. é"]
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=40, max_size=40))
def test_blocks_agree_with_python_re(spark, texts):
    def expected(text):
        for shape, (flags, head, end) in prose.SHAPES.items():
            pattern = (flags + head + prose._EVIDENCE + "?" + end).replace(r"\z", r"\Z")
            found = [
                (int(m[1]), m[2].strip(), m[3], None if m[3] is None else m.start(3), shape)
                for m in re.finditer(pattern, text)
            ]
            if found:
                return found
        return []

    assert blocks(spark, texts) == [expected(t) for t in texts]


def test_questions_last_wins(spark):
    got = column(spark, ["Q1. a\nmore\nQ2. b\nQ1. c", "none"], prose.questions)
    assert [[tuple(q) for q in r] for r in got] == [[(1, "c"), (2, "b")], []]


def test_citation_positions(spark):
    text = "Q1. é\nA1. é\nEvidence. é ([x](https://a/1)) ([]())"
    (got,) = column(spark, [text], lambda c: prose.prose_citations(prose.answer_blocks(c)))
    assert [text[c.char_pos : c.char_pos + 3] for c in got] == ["([x", "([]"]
    assert [(c.url, c.title, c.empty_placeholder) for c in got] == [("https://a/1", "x", False), (None, None, True)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_searched_once(spark):
    """A pattern stands once in the plan: each further place would search every text again."""
    df = spark.createDataFrame([("x",)], "t string").withColumn("b", prose.echo_blocks(F.col("t")))
    assert plan_of(df.select("b")).count("regexp_extract_all(") == 1
    cited = df.select("b", F.lit(1).alias("n")).localCheckpoint().select(prose.prose_citations(F.col("b")).alias("c"))
    assert plan_of(cited).count("regexp_extract_all(") == 1


def test_strip_of_long_texts_equals_strip(spark):
    texts = [None, "", " ", "a", " a", "a ", " a　", "\x1c", "a b", "é", "\té\n", "​", "a​ "]
    assert column(spark, texts, tx.strip_long) == column(spark, texts, tx.strip)
    assert column(spark, texts, tx.is_blank) == column(spark, texts, lambda c: tx.strip(c) == "")


def test_blocks_with_odd_labels(spark):
    """Labels alone, doubled, without a mark or far below their answer, in both shapes."""
    def evidence(texts, shape):
        return [[(b["qnum"], b["answer"], b["evidence"], b["evidence_start"]) for b in r] for r in column(spark, texts, shape)]

    bare = ["A1. x\n\n\nEvidence.", "A1. x\nEvidence: y\nEvidence. z", "A1.\nEvidence\t é", "A1. a\n\nA2. b\nEvidence é (x)", "A1. "]
    assert evidence(bare, prose.bare_blocks) == [
        [(1, "x", "", 17)], [(1, "x", "y\nEvidence. z", 16)], [(1, "", "é", 14)],
        [(1, "a", None, None), (2, "b", "é (x)", 22)], [(1, "", None, None)],
    ]
    assert evidence(["Q1. q\nA1. é\nEvidence. w\n\nQ2. r\nA2. v"], prose.echo_blocks) == [
        [(1, "é", "w", 22), (2, "v", None, None)]
    ]
