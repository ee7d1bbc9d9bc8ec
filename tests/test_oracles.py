"""Every query against its SQL in DuckDB, and those without SQL for rows."""

import pytest

from marlgrove.plans import registry

from . import oracle

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert oracle.compare(df, con, registry.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
