import numpy as np
import pytest
from pyspark.sql import functions as F

from askledger.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.0, 0, 0) for i, v in rows], SCHEMA)


def exact(rows, queries, k):
    out = {}
    for q, y in rows:
        if q in queries:
            far = sorted((float(np.sqrt(((np.float32(x).astype(float) - np.float32(y).astype(float)) ** 2).sum())), i) for i, x in rows if i != q)
            out[q] = far[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64)) for i in range(1500)]
    found = neighbours.search(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    true = exact(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    hits = 0
    for q, best in true.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        near = {i for _, i in best}
        hits += sum(r.vec_id in near for r in mine)
        assert all(r.score == pytest.approx(dict((i, s) for s, i in exact(rows, {q}, 1500)[q])[r.vec_id], abs=1e-12) for r in mine[:2])
    assert hits >= 0.9 * 10 * len(true)


def test_equal_vectors_ties_and_rows_that_take_no_part(spark):
    same, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, same) for i in range(300)] + [(i, other) for i in range(300, 304)]
    rows += [(400, None), (500, [0, 0, 0]), (600, [1, None, 0]), (700, [float("nan"), 1, 0]), (800, [float("inf"), 1, 0]), (900, [1, 2]), (None, same), (0, same)]
    found = neighbours.search(table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    by = {q: [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] for q in {r.query_id for r in found}}
    assert set(by) == {0, 100, 200, 300}
    assert by[0] == list(range(1, 11)) and by[100] == list(range(10)) and by[200] == list(range(10)) and by[300][:3] == [301, 302, 303]


def test_few_rows_and_none(spark):
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(table(spark, [(0, [1, 0]), (1, [3, 0])]), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert neighbours.search(table(spark, []), F.col("vec_id") == 0).collect() == []


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 12))
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_all_candidates_where_they_are_few(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=64)) for i in range(10)]
    found = neighbours.search(table(spark, rows), F.col("vec_id") < 3).collect()
    for q, best in exact(rows, {0, 1, 2}, 10).items():
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in best]
