import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

# All queries take some minutes even on the smallest tables: ALL_QUERIES=1 runs them all, and
# python -m checks.compare does so at any scale.
SOME = [
    "scorecard", "third_run_totals", "usage_by_run", "cut_to_two_runs", "url_overlap", "shared_prefix_by_source",
    "mask_queries", "leftover_by_field", "run_defects", "reconcile_runs", "weblog_calls", "anomaly_payload",
    "citation_queries", "anomaly_payload_of_three", "merged_counts", "input_terms", "output_answers", "output_citations", "health",
]
# Queries without SQL are tested against brute force with the operators they apply.
NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    result = compare(spark, con, SMALL, entry.queries()[name], SQL.get(name))
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", ["mask_queries", "scorecard", "third_run", "usage_by_tier"])
def test_hot_paths_run_no_python(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
