"""Every registered query against the same question in SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got = compare(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df())
    assert got.startswith("ok"), got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
