"""Queries against their SQL."""

import pytest

from relevantia.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, small, against_sql, name):
    against_sql(queries()[name](spark, small), oracle_sql()[name])


def test_every_query_has_rows(spark, small):
    for name in sorted(queries().keys() - oracle_sql().keys()):
        assert queries()[name](spark, small).count() > 0, name
