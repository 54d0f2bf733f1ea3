import pytest

from gridspark.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    assert all(kind != "void" for _, kind in df.dtypes)
    oracle.same(df, catalog.ORACLE[name], con)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
