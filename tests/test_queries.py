"""Every registered query of the core against its SQL on the smallest tables."""

import importlib.util

import pytest

import __spark_entry__ as entry
from quern.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, data, duck, rows_of, name):
    df = registry.QUERIES[name](spark, data)
    mine = rows_of(df.columns, df.collect())
    if name in registry.SQL:
        cur = duck.execute(registry.SQL[name])
        assert mine == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_sql_only_for_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_has_all(spark):
    assert set(registry.QUERIES) <= set(entry.queries())
    if importlib.util.find_spec("quern.llm") is None:
        assert set(registry.QUERIES) == set(entry.queries())


def test_flagship(spark, data):
    assert entry.entry(spark).columns
