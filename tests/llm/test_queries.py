import pytest

from keyflow.llm.queries import ORACLES, QUERIES

from .. import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="no tables")


def test_there_is_one_query_for_each_operator():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name], oracle.connection())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_cover_all_documents(spark, name):
    ids = {r.doc_id for r in QUERIES[name](spark, oracle.SF).select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id").collect()}
