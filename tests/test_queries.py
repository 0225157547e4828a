"""Every query with SQL against DuckDB, and the driver's contract."""

from __future__ import annotations

import pytest

from conftest import DATA, plain
from tapeloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = oracle(registry.SQL[name], "sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").columns


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
