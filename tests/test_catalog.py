"""Every registered query of the library against its SQL twin; queries without one must return rows."""

import pytest

from factloom import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert_same(df, catalog.ORACLES[name], sf_dir)
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_names_are_unique():
    """No module's query hides another's."""
    assert len(catalog.QUERIES) == sum(len(m.QUERIES) for m in catalog._MODULES) and set(catalog.ORACLES) <= set(catalog.QUERIES)
