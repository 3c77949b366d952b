import pytest

import __spark_entry__ as entry
from newsloom import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, data, duck, same_rows, name):
    same_rows(registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    rows = registry.QUERIES[name](spark, data)
    assert rows.count() > 0 and any(v is not None for r in rows.limit(5).collect() for v in r)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
