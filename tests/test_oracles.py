import pytest

from mendframe import catalog

from .compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    sql = catalog.oracles().get(name)
    df = catalog.queries()[name](spark, SF)
    if sql is None:
        df.collect()
    else:
        assert difference(df, con, sql) is None
