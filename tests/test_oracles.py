import pytest

from quillon import queries as core
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, con, data, name):
    compare(spark, con, data, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, data, name):
    df = core.queries()[name](spark, data)
    df.collect()
    assert df.columns
