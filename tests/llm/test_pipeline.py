import corpus_pipeline as pipeline
from test_near_duplicates import brute_force

from askledger.llm import secrets


def test_stages_keep_and_change_what_they_should(spark, prose, tmp_path):
    leak = prose(40, 1)
    rows = [
        (1, prose(80, 10), "en"), (2, prose(80, 10) + " end", "en"), (3, "1234 5678 !!", None), (4, prose(50, 11) + " " + leak, "en"), (5, prose(60, 12) + " token = 'abcdefabcdef12345'", None),
        (6, None, "en"), (7, prose(3000, 13), "en"), (8, "中文" * 40, None),
    ] + [(100 + k, prose(70, 200 + k), "en") for k in range(20)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    (_, language), (_, dedup), (_, clean), (_, redact), (_, pack) = pipeline.STAGES

    one = language(spark, docs, folder)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert one.columns == docs.columns and ids(one) == ids(docs) - {3, 6, 8}
    texts = {i: t for i, t, _ in rows if i in ids(one)}
    two = dedup(spark, one, folder)
    assert two.columns == docs.columns and ids(two) == {i for i, (_, c) in brute_force(list(texts.items())).items() if i == c}
    three = clean(spark, two, folder)
    assert three.columns == docs.columns and ids(three) == ids(two) - {4}
    four = redact(spark, three, folder)
    assert four.columns == docs.columns and four.schema["n_chars"].dataType == docs.schema["n_chars"].dataType and ids(four) == ids(three)
    assert next(r.text for r in four.collect() if r.doc_id == 5).endswith("[assign]'")
    assert secrets.scan(four).where("size(spans) > 0").count() == 0
    assert ids(pack(spark, four, folder)) == ids(four) == {r.doc_id for r in pipeline.run(spark, folder).collect()}
