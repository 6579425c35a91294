import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm.split import pieces, split_oversized

PROSE = " ".join(f"Sentence number {i} tells of the {w} in the hall." for i, w in enumerate("lamp door rug clock vase table chair shelf mirror stove".split() * 12))


def check(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
    return got


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,é字。", min_size=1, max_size=900), st.integers(20, 200), st.integers(0, 19))
def test_limits_hold_for_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_are_natural_and_edits_stay_local():
    got = check(PROSE, 1300, 300)
    assert len(got) > 3 and all(PROSE[b - 1] in ". " for _, b in got)
    before = {PROSE[a:b] for a, b in got}
    edited = PROSE[:700] + "An insertion. " + PROSE[700:]
    after = [edited[a:b] for a, b in pieces(edited)]
    assert sum(p not in before for p in after) <= 3 and after[-1] in before


def test_unbroken_text_and_marks_stay_whole():
    check("x" * 5000, 1300, 300)
    thai = "กำ" * 2000
    for a, b in check(thai, 1300, 300):
        assert b == len(thai) or thai[b] != "ำ"


def test_table(spark):
    rows = [("a", PROSE, 1), ("a", PROSE, 2), ("b", "short", 5), ("c", None, 0), ("d", "", 0), (None, PROSE, 0), ("e", "y" * 1300, 9), ("f", "z" * 1301, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, char_count int")
    got = split_oversized(df).collect()
    assert {r["chunk_id"] for r in got} == {"a", None, "f"}
    a = sorted((r for r in got if r["chunk_id"] == "a"), key=lambda r: r["piece_index"])
    assert [r["piece_index"] for r in a] == list(range(len(a))) and all(r["text"] == PROSE[r["start_pos"] : r["end_pos"]] and r["char_count"] == len(r["text"]) for r in a)
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces(PROSE, 100, 100)


def test_random_texts_keep_their_cuts_far_from_an_edit():
    rng = random.Random(1)
    changed = []
    for _ in range(15):
        text = " ".join(f"{rng.choice('The A One'.split())} {''.join(rng.choice('abcdefgh') for _ in range(rng.randint(3, 9)))} {rng.randint(1, 999)} went on." for _ in range(400))
        before = {text[a:b] for a, b in pieces(text)}
        after = pieces(text[:500] + "New words. " + text[500:])
        edited = text[:500] + "New words. " + text[500:]
        changed.append(sum(edited[a:b] not in before for a, b in after) / len(after))
    assert sum(changed) / len(changed) < 0.3
