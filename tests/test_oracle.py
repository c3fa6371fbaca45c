"""Every core query that SQL can express gives the same rows in DuckDB."""

import pytest

from tests.compare import connect, difference
from tracewright.plans.registry import core_queries, core_sql

QUERIES, SQL = core_queries(), core_sql()


def test_names():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 70


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), SQL[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert {"s1_corpus_files", "p3_found"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
