import pytest

import __spark_entry__ as entry
from skeinflow.plans import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, con, name):
    same(catalog.QUERIES[name](spark, data), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert len(df.collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
