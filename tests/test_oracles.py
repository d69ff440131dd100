"""Each registered query against its SQL twin over the smallest tables."""

import pytest
from oracle import compare, connect

from corpusloom.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_matches_sql(spark, small, con, name):
    assert compare(registry.QUERIES[name](spark, small), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
