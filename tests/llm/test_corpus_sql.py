"""Corpus queries with SQL give the rows their SQL gives."""

from __future__ import annotations

import pytest

from tabflow.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def oracle(data):
    return connect(data)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, oracle, name):
    problem = compare(QUERIES[name](spark, data), oracle, SQL[name])
    assert problem is None, problem
