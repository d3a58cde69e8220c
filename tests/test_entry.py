import duckdb
import pytest

import __spark_entry__ as entry
from testbed.registry import ORACLES, QUERIES
from tools.check_oracles import compare, connect


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].num_examples > 0


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def connection(folder):
    found = connect(folder)
    assert isinstance(found, duckdb.DuckDBPyConnection)
    return found


# One query per area; tools/check_oracles.py runs all of them.
SAMPLE = [
    "batch_assign", "canonical_cells", "exec_match", "extract_sql", "preview_counts", "profile_topk", "rank_arms",
    "result_match_unordered", "summary_by_group", "tool_budget",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, connection, folder, name):
    assert compare(spark, connection, name, folder).startswith("ok")
