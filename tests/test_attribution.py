from support import rows

from askledger.operators import attribution

CITED = "se10 string, run_id int, domain string, question string, query_text string"
SAID = "se10 string, run_id int, query_text string, domain string"
SHOWN = ("se10", "domain", "n_citations", "query_text", "query_run", "score", "runner_up", "is_ambiguous")


def test_best_query_margin_and_citations_without_one(spark):
    cited = [("1", 0, "www.Shop.example", "any complaints", "x")] * 2 + [("1", 0, None, "any complaints", "x"), ("2", None, "", None, "x"), (None, 0, "shop.example", "any", "x")]
    said = [("1", 0, "complaints", "y"), ("1", 1, "info@shop.example", "y"), ("1", 1, "any complaints", "y"), ("1", 1, "any complaints", "y"), ("1", 0, None, "y"), ("3", 0, "any", "y"), (None, 0, "any", "y")]
    found = attribution.best_queries(spark.createDataFrame(cited, CITED), spark.createDataFrame(said, SAID))
    assert rows(found, *SHOWN) == sorted(
        [
            ("1", "www.Shop.example", 2, "info@shop.example", 1, 100, 60, False), ("1", None, 1, "any complaints", 1, 60, 50, True),
            ("2", "", 1, None, None, None, None, False), (None, "shop.example", 1, None, None, None, None, False),
        ],
        key=repr,
    )


def test_pieces_of_a_hot_entity_find_the_same(spark):
    cited = spark.createDataFrame([("1", k % 3, f"s{k % 5}.example", f"word{k % 7} shop", "x") for k in range(200)], CITED)
    said = spark.createDataFrame([("1", k % 4, f"shop s{k % 6}.example word{k % 9}", "y") for k in range(60)], SAID)
    whole, cut = (rows(attribution.best_queries(cited, said, min_rows=m)) for m in (10**6, 10))
    assert whole == cut and len(whole) == 105 and sum(r[4] for r in whole) == 200


def test_empty(spark):
    none = spark.createDataFrame([], CITED), spark.createDataFrame([], SAID)
    assert rows(attribution.best_queries(*none)) == []
    one = spark.createDataFrame([("1", 0, "a.example", "b", "x")], CITED)
    assert attribution.best_queries(one, none[1]).first().score is None


def test_queries_in_several_packed_rows_find_the_same_and_no_word_is_shuffled(spark):
    cited = spark.createDataFrame([(str(k % 2), k % 3, f"s{k % 5}.example", f"word{k % 7} shop", "x") for k in range(60)], CITED)
    said = spark.createDataFrame([(str(k % 2), k % 4 or None, f"shop s{k % 6}.example word{k % 9}", "y") for k in range(60)], SAID)
    whole, cut = (rows(attribution.best_queries(cited, said, limit=m)) for m in (1024, 4))
    assert whole == cut and len(whole) == 60
    # a packed row holds all distinct queries of a small entity, so as many rows meet as there are entities
    assert attribution.pack_queries(said).count() == 2 and attribution.pack_queries(said, 4).count() > 4
