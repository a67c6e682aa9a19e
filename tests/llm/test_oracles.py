"""The registered queries that SQL can say, beside their DuckDB text."""

import pytest

from oracle_check import compare, connect
from placegrid.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_agrees_with_its_oracle(spark, name):
    ok, text = compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name])
    assert ok, text


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
