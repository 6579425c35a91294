import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.mixing import TOKENIZER, budgets, load_tokenizer, mix

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file here")


def test_exact_shares_where_no_cap_binds():
    got = budgets([("d", "en", "a", 100), ("d", "de", "a", 50), ("e", "en", "b", 300)], {"a": (0.5, None), "b": (0.5, None)}, 300, {})
    assert got == {("d", "en", "a"): 100, ("d", "de", "a"): 50, ("e", "en", "b"): 150}


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [("x", "en", "a", 10), ("x", "en", "b", 1000), ("y", "en", "c", 1000)]
    got = budgets(leaves, {"a": (0.25, 1), "b": (0.25, None), "c": (0.5, None)}, 400, {})
    assert got == {("x", "en", "a"): 10, ("x", "en", "b"): 190, ("y", "en", "c"): 200}
    got = budgets(leaves, {"a": (0.25, 1), "b": (0.25, 0), "c": (0.5, None)}, 400, {})
    assert got == {("x", "en", "a"): 10, ("x", "en", "b"): 0, ("y", "en", "c"): 390}


def test_absent_source_leaves_its_share_to_its_domain():
    got = budgets([("x", "en", "a", 1000), ("y", "en", "c", 1000)], {"a": (0.2, None), "gone": (0.2, None), "c": (0.6, None)}, 100, {"gone": "x", "a": "x", "c": "y"})
    assert got == pytest.approx({("x", "en", "a"): 40, ("y", "en", "c"): 60})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from(["en", "de"]), st.sampled_from("abcd"), st.integers(0, 500)), max_size=12, unique_by=lambda t: t[:3]), st.lists(st.sampled_from([None, 0, 1, 3]), min_size=4, max_size=4), st.integers(0, 3000))
def test_budgets_keep_caps_and_fill_the_total(leaves, caps, total):
    weights = {s: (0.1 * (i + 1), c) for i, (s, c) in enumerate(zip("abcd", caps))}
    got = budgets(leaves, weights, total, {})
    room = {(d, lang, s): n * weights[s][1] if weights[s][1] is not None else total * (n > 0) for d, lang, s, n in leaves}
    assert all(-1e-6 <= got[k] <= room[k] + 1e-6 for k in got)
    assert sum(got.values()) == pytest.approx(min(total, sum(room.values())), abs=1e-3)


@needs_tokenizer
def test_mix(spark):
    rows = [(i, f"text number {i} of the big source, about nothing in particular", "en", "Big Source", 0) for i in range(200)]
    rows += [(1000 + i, f"kleiner Text {i} aus der kleinen Quelle", "DE" if i % 2 else "de-AT", " small_source ", 0) for i in range(10)]
    rows += [(2000, rows[0][1], "en", "BIG-SOURCE", 0), (2001, "", "en", "big_source", 0), (2002, None, "en", "big_source", 0), (2003, "  ", None, None, 0), (2004, "unlisted text", "en", "other", 0), (2005, "lost", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    weights = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.3, 4), ("absent", 0.2, None)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs, weights)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"big_source", "small_source", "absent", "other", "unknown"}
    assert r["small_source"]["mix_tokens"] == 4 * r["small_source"]["available_tokens"] and r["small_source"]["most_repeats"] == 4
    assert r["big_source"]["most_repeats"] == 1 and r["absent"]["mix_tokens"] == r["other"]["mix_tokens"] == 0
    assert sum(x["reached_share"] for x in r.values()) == pytest.approx(1)
    enc = load_tokenizer(TOKENIZER)
    distinct = {t: len(enc.encode_ordinary(t)) for _, t, _, s, _ in rows if t and s and "big" in s.lower()}
    assert r["big_source"]["available_tokens"] == sum(distinct.values())
    picked = mixed.collect()
    assert len({x["doc_id"] for x in picked}) == len(picked) and 2000 not in {x["doc_id"] for x in picked}
    assert sorted(map(tuple, mix(docs, weights)[0].collect())) == sorted(map(tuple, picked))
    half = {x["source"]: x for x in mix(docs, weights, total_tokens=400)[1].collect()}
    assert sum(x["mix_tokens"] for x in half.values()) == pytest.approx(400, abs=20)
    assert half["small_source"]["reached_share"] == pytest.approx(0.375, abs=0.05)


@needs_tokenizer
def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs, weights)
    assert mixed.count() == 0 and [tuple(x) for x in report.collect()] == [("a", 1.0, 1, 0, 0, None, None, 0)]
    docs = spark.createDataFrame([(1, "x y", "en", "a")], "doc_id long, text string, lang string, source string")
    mixed, report = mix(docs, weights.limit(0))
    assert mixed.count() == 0 and report.count() == 1
