"""Queries against their SQL."""

import pytest

from relevantia.llm import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, small, against_sql, name):
    against_sql(queries()[name](spark, small), oracle_sql()[name])


def test_ten_queries():
    assert [sum(k.startswith(f"op{n}_") for k in queries()) for n in range(1, 11)] == [1] * 10
