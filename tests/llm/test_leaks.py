import random
import re

import pytest

from gleanery.llm import leaks as leaks_module
from gleanery.llm.leaks import leaks, passage_words, winnow

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]
ITEMS = [(f"g{i}", " ".join(RNG.choice(WORDS) for _ in range(16)) + "?", None if i % 3 else " ".join(RNG.choice(WORDS) for _ in range(40)) + ".", "" if i % 2 else " ".join(RNG.choice(WORDS) for _ in range(30))) for i in range(12)]


def brute(docs, items, n=12):
    grams = {}
    for q, *fields in items:
        for f in fields:
            t = passage_words(f or "")
            for i in range(len(t) - n + 1):
                grams.setdefault(tuple(t[i : i + n]), set()).add(q)
    out = set()
    for d, t in docs:
        w = passage_words(t or "")
        for i in range(len(w) - n + 1):
            out |= {(d, q) for q in grams.get(tuple(w[i : i + n]), ())}
    return out


@pytest.fixture(scope="module")
def docs():
    out = [(900, None), (901, ""), (902, "w1 w2")]
    for d in range(80):
        text = [RNG.choice(WORDS) for _ in range(RNG.randint(5, 200))]
        if d % 2:
            q, *fields = RNG.choice(ITEMS)
            words = (RNG.choice([f for f in fields if f]) or "").split()
            n = RNG.randint(8, len(words))
            at = RNG.randint(0, len(words) - n)
            part = [w.upper() if d % 3 else w for w in words[at : at + n]]
            if d % 5 == 0:
                part[2] = f"<b>{part[2]}</b> [7]"
            if d % 7 == 0:
                part[4] = part[4][:1] + "​" + part[4][1:] + ","
            text[len(text) // 2 : len(text) // 2] = part
        out.append((d, " ".join(text)))
    return [*out, (3, out[6][1])]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_against_brute_force_both_ways(spark, docs, limit):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame(ITEMS, "question_id string, question string, expected_answer string, answer string")
    found = leaks(d, g, broadcast_prints=limit)
    want = brute(docs, ITEMS)
    assert len(want) > 15 and {(r["doc_id"], r["question_id"]) for r in found.select("doc_id", "question_id").distinct().collect()} == want
    assert all(r["words"] >= 12 for r in found.collect())


def test_window_guarantee():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 1 << 63, 12, np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 20), np.uint64), shared, rng.integers(0, 1 << 63, rng.integers(0, 20), np.uint64)]) for _ in range(2))
        assert set(winnow(a)[0].tolist()) & set(winnow(b)[0].tolist())


def test_words_that_do_not_count():
    assert passage_words("The <b>net</b> sales[12] ROSE, by­ 5.3 % – see ﻿it") == ["the", "net", "sales", "rose", "by", "5", "3", "see", "it"]
    assert re.sub("x", "", "".join(passage_words("café"))) == "café"


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    g = spark.createDataFrame(ITEMS, "question_id string, question string, expected_answer string, answer string")
    assert leaks(d, g).count() == 0
    some = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id long, text string")
    assert leaks(some, g.limit(0)).count() == 0 and leaks(some, g.limit(0), broadcast_prints=-1).count() == 0
    with pytest.raises(ValueError):
        leaks(some, g, passage=1)


def test_long_tags_do_not_break_a_passage():
    tag = f"<span style='{'x: y; ' * 200}'>"
    assert len(tag) > 400 and passage_words(f"one {tag}two</span> three") == ["one", "two", "three"]
    assert passage_words("less < " + "than " * 100 + "> more")[0:2] == ["less", "than"]  # prose between signs far apart stays


def test_a_hash_that_most_documents_have_is_met_in_blocks(spark, monkeypatch):
    """Boilerplate of an item in most documents, by the way of large item sets."""
    monkeypatch.setattr(leaks_module, "BLOCK", 5)
    passage = "the company makes no promise that any of this will come to pass as said here"
    rows = [(i, f"{passage} doc {i}") for i in range(60)] + [(100, "nothing of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", passage, None, None), ("b", None, passage.upper(), "x")], "question_id string, question string, expected_answer string, answer string")
    found = {(r["doc_id"], r["question_id"]) for r in leaks(df, items, broadcast_prints=-1).collect()}
    assert found == {(i, q) for i in range(60) for q in "ab"}
