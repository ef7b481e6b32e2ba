import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from askledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    # Small data: compiling generated code would take most of the time.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return session


@pytest.fixture
def bronze(spark):
    """Bronze rows of one file from its lines."""
    from askledger.sources.lines import as_bronze

    def make(lines, kind="weblog", name="f.jsonl"):
        rows = [(name, i + 1, line) for i, line in enumerate(lines)]
        return as_bronze(spark.createDataFrame(rows, "src_file string, src_line bigint, value string"), kind)

    return make
