import random

import numpy as np

from askledger.llm import decontamination as dc

BENCH = "item_id long, text string, doc_id long"


def edit_distance_anywhere(window, text):
    """Least edits of the whole window against any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(window, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def damaged(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([[], ["#"], [chars[k], "#"]])
    return "".join(chars)


def test_agrees_with_plain_alignment(documents, spark, prose):
    rng = random.Random(8)
    items = [(k, prose(rng.choice([8, 25, 60]), 40 + k)) for k in range(6)]
    rows = []
    for d in range(40):
        item = items[d % 6][1]
        part = item[: len(item) // 2] if d % 5 == 4 else item
        body = damaged(part, rng.randint(0, 14), rng)
        rows.append((d, f"{prose(30, 900 + d)} {body.upper() if d % 3 else body} {prose(20, 800 + d)}"))
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(documents(rows), spark.createDataFrame([(*i, 0) for i in items], BENCH)).collect()}
    expected = set()
    fold = lambda t: "".join(map(chr, dc.folded(t)))
    for d, text in rows:
        for k, item in items:
            whole = fold(item)
            windows = [whole[s : s + dc.WINDOW] for s in dc.window_starts(len(whole))]
            if any(edit_distance_anywhere(w, fold(text)) <= dc.budget(len(w)) for w in windows):
                expected.add((d, k))
    assert found == expected and len(expected) > 15


def test_spans_and_clean_documents(documents, spark, prose):
    item = prose(30, 1)
    rows = [(1, "é\n " + item.replace(" ", "\n") + " end"), (2, prose(200, 2)), (3, None), (4, ""), (5, item), (5, item), (None, item)]
    bench = spark.createDataFrame([(7, item, 0), (8, None, 0), (9, "", 0), (10, "tiny", 0), (None, prose(30, 3), 0)], BENCH)
    found = dc.contaminated(documents(rows), bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.start, r.end, r.edits) for r in found) == sorted([("1", 7, 3, 3 + len(item), 0), *[(i, 7, 0, len(item), 0) for i in ("5", "5", "None")]])
    clean = dc.keep_clean(documents(rows), bench)
    assert clean.columns == documents(rows).columns and {r.doc_id for r in clean.collect()} == {2, 3, 4}


def test_several_indexes_find_the_same(documents, spark, prose):
    items = [(k, prose(30, 60 + k), 0) for k in range(9)]
    docs = documents([(k, prose(50, k) + " " + items[k][1]) for k in range(9)])
    bench = spark.createDataFrame(items, BENCH)
    one, many = (sorted(map(tuple, dc.contaminated(docs, bench, index_chars=c).collect())) for c in (10**6, 300))
    assert one == many and len(one) == 9
    assert dc.keep_clean(docs, bench, index_chars=300).collect() == []


def test_odd_rows_and_empty_tables(documents, spark, odd_rows):
    bench = spark.createDataFrame([(1, "some text of the benchmark that is nowhere else to be found", 0)], BENCH)
    assert dc.contaminated(documents(odd_rows), bench).collect() == [] and dc.keep_clean(documents(odd_rows), bench).count() == len(odd_rows)
    nothing = spark.createDataFrame([], BENCH)
    assert dc.contaminated(documents(odd_rows), nothing).collect() == [] and dc.keep_clean(documents(odd_rows), nothing).count() == len(odd_rows)
    assert dc.contaminated(documents([]), bench).collect() == []


def test_alignment_places():
    window, region = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ("abcdefgh", "xxabXcdeghyy"))
    assert dc.align(window, region, 2) == (2, 2, 10) and dc.align(window, region, 1) is None


def test_part_quotations_and_short_items(documents, spark, prose):
    rng = random.Random(6)
    items = [(k, prose(70, 300 + k), 0) for k in range(8)] + [(90, "Zyx 7", 0), (91, " \t", 0)]
    rows = []
    for d in range(40):
        item = items[d % 8][1]
        at = rng.randrange(len(item) - 64)
        rows.append((d, f"{prose(30, 500 + d)} {item[at : at + 64]} {prose(30, 700 + d)}"))
    rows += [(50, prose(20, 3) + " zyx\n7."), (51, prose(20, 4))]
    found = {(r.doc_id, r.item_id): r for r in dc.contaminated(documents(rows), spark.createDataFrame(items, BENCH)).collect()}
    assert all((d, d % 8) in found for d in range(40)) and (50, 90) in found and not any(d == 51 or i == 91 for d, i in found)
    start = found[50, 90].start
    assert rows[40][1][start : found[50, 90].end] == "zyx\n7"


def test_repeated_grams_of_a_text_count_once(documents, spark):
    item = "row 10 of a table: " + "=" * 10 + " and no more of it is quoted anywhere else in this collection"
    bench = spark.createDataFrame([(1, item, 0)], BENCH)
    index = dc.Index.of([(1, item)])
    rule = dc.folded("x" + "=" * 5000)
    assert len(index.candidates(rule, np.zeros(len(rule), int))) == 0
    found = dc.contaminated(documents([(1, "=" * 5000), (2, "=" * 500 + " " + item + "=" * 500)]), bench).collect()
    assert [(r.doc_id, r.start, r.end) for r in found] == [(2, 501, 501 + len(item))]
