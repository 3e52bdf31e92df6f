import re

import pytest

import __spark_entry__ as entry
from millrace.llm import queries
from oracle_compare import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_each_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_duckdb(spark, name):
    ok, note, _ = compare(spark, connect(SMALL), name, entry.queries()[name], queries.ORACLE_SQL[name], SMALL)
    assert ok, note
