import os

import pytest

from gleanery.llm.queries import QUERIES
from gleanery.llm.sql import SQL
from tests.oracle import DATA, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, connect(), name, QUERIES[name], SQL[name])


def test_recall_of_the_index(spark):
    assert QUERIES["p2_recall"](spark, DATA).first()["recall"] >= 0.9


@pytest.mark.parametrize("name", ["p1_pieces", "p3_found", "p3_kinds", "p4_found", "p7_mix", "p7_shares", "p8_found", "p8_redacted"])
def test_queries_without_sql_give_rows(spark, name):
    if name.startswith("p7") and not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary file here")
    assert QUERIES[name](spark, DATA).count() > 0
