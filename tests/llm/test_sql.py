"""Queries against their SQL in DuckDB, and the guard around this package."""

import pytest

from marlgrove.llm import queries

from .. import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name]) == ""


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert [n for n in queries.QUERIES if n.startswith("op")] == [n for n in entry.queries() if n.startswith("op")]
