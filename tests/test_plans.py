import os
import re

import pytest

from gleanery.operators import dense, lexical
from gleanery.plans import registry
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
#: Sixteen spans, where the smallest tables have one at most.
SPANS = os.path.join(os.path.dirname(DATA), "sf0.01")


def operators(df, name):
    return len(re.findall(name, df._jdf.queryExecution().optimizedPlan().toString()))


def test_lists_are_made_once(spark):
    """What an evaluation reads are kept lists, not their plans again; a summary extracts sections once."""
    assert operators(registry.QUERIES["eval_strategies"](spark, DATA), "Relation|MapInArrow") == 0
    assert operators(registry.QUERIES["eval_gold"](spark, DATA), "MapInArrow") == 1
    assert operators(registry.QUERIES["filing_summary"](spark, DATA), "Relation") == 2


@pytest.mark.parametrize("name", ["retrievers", "evaluate_retrievers", "evaluate_questions"])
def test_retrievers_of_a_query_search_once(spark, monkeypatch, name):
    searched = []
    for module, f in ((lexical, lexical.search), (dense, dense.knn)):
        monkeypatch.setattr(module, f.__name__, lambda *a, f=f: searched.append(f.__name__) or f(*a))
    registry.QUERIES[name](spark, DATA)
    assert sorted(searched) == ["knn", "search"]


@pytest.mark.parametrize("name", ["summary_table", "won_only_by_semantic", "eval_strategies"])
def test_more_spans_than_are_sent_at_once_are_not_joined_with_the_postings(spark, monkeypatch, name):
    rows = lambda: sorted(map(tuple, registry.QUERIES[name](spark, SPANS).collect()))
    whole, joined, sent = rows(), [], []
    for f, calls in ((lexical._by_join, joined), (lexical._in_tasks, sent)):
        monkeypatch.setattr(lexical, f.__name__, lambda *a, f=f, calls=calls: calls.append(1) or f(*a))
    monkeypatch.setattr(lexical, "SENT_QUERIES", 6)
    monkeypatch.setattr(lexical, "JOINED", 0, raising=False)
    assert rows() == whole and whole
    assert not joined and len(sent) > 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["low_faithfulness"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "scores.faithfulness" in plan.split("PushedFilters")[1] and "answer" not in plan.split("ReadSchema")[1]
