"""Every catalog query with SQL equals DuckDB; the others run and have rows."""

import pytest

from tessera.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, same):
    same(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
