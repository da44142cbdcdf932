import pytest

from keyflow.queries import ORACLES, QUERIES

from . import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0
