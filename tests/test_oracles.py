import os

import pytest

from gleanery.plans import registry
from tests.oracle import DATA, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, name, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_arrow_fold_equals_the_fold_in_sql(spark):
    a = registry.QUERIES["chunk_semantic"](spark, DATA).select("doc_id", "chunk_index", "text")
    b = registry.QUERIES["chunk_semantic_arrow"](spark, DATA)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select("doc_id", "chunk_index", "text").collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
