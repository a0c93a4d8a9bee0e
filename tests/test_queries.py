"""Registered queries against their SQL on the smallest tables."""

import pytest

from ohmgraph.queries import registry

from .conftest import against_sql


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    left, right = against_sql(spark, registry.QUERIES[name], registry.ORACLES[name])
    assert left == right


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
