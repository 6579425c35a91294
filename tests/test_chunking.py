import random

import pytest

from gleanery.operators import chunking
from gleanery.operators.chunking import py_semantic, py_sentences


def brute_fixed(text, size, overlap):
    out, cur = [], []
    for s in py_sentences(text):
        if len(" ".join([*cur, s])) <= size:
            cur.append(s)
            continue
        tail = []
        if cur:
            out.append(" ".join(cur))
            for t in reversed(cur):
                if len(" ".join([t, *tail])) > overlap:
                    break
                tail.insert(0, t)
        cur = [*tail, s]
    return [*out, " ".join(cur)] if cur else out


def brute_recursive(text, size):
    import re

    def split(t):
        if len(t) <= size:
            return [t.strip()]
        paragraphs = [p.strip() for p in re.split(r"\n{2,}", t) if p.strip()]
        if len(paragraphs) > 1:
            return [x for p in paragraphs for x in split(p)]
        sentences = py_sentences(t)
        if len(sentences) > 1:
            out, cur = [], []
            for s in sentences:
                if len(" ".join([*cur, s])) <= size:
                    cur.append(s)
                else:
                    out += [" ".join(cur)] if cur else []
                    cur = [s]
            return [*out, " ".join(cur)]
        return [t[i : i + size].strip() for i in range(0, len(t), size)]

    return [x for x in split(text) if x]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    out = ["", "   ", "One.", "x" * 700, "a. " * 300]
    for _ in range(120):
        t = ""
        for _ in range(rng.randint(1, 30)):
            t += " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) + rng.choice([". ", "! ", "? ", " ", ".\n\n", "\n"])
        out.append(t)
    return out


@pytest.mark.parametrize("name", ["fixed", "recursive", "semantic"])
def test_folds_follow_python(spark, texts, name):
    column = {"fixed": chunking.fixed_size("x", 300, 80), "recursive": chunking.recursive("x", 300), "semantic": chunking.semantic("x", 150, 300, 0.5)}[name]
    brute = {"fixed": lambda t: brute_fixed(t, 300, 80), "recursive": lambda t: brute_recursive(t, 300), "semantic": lambda t: py_semantic(t, 150, 300, 0.5)}[name]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", "x", column.alias("c")).collect()
    for r in rows:
        assert r["c"] == brute(r["x"]), (r["i"], r["x"][:80])


def test_chunk_rows_and_unknown_strategy(spark):
    s = spark.createDataFrame([("A B.html", None, "Item 1", None, "One. Two."), ("A B.html", None, "Item 2", None, None)], "source_file string, part string, item string, title string, text string")
    rows = chunking.chunk(s, "semantic").collect()
    assert [(r["chunk_id"], r["text"], r["metadata"]["token_count"]) for r in rows] == [("a_b_item1_chunk_001", "One. Two.", 2)]
    with pytest.raises(ValueError):
        chunking.chunk(s, "unheard")


def test_arrow_variants(spark):
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven."), (2, None), (3, "")], "id int, text string")
    assert [(r["id"], r["text"]) for r in chunking.arrow_semantic(df, "id").collect()] == [(1, "One two three. Four five six. Seven.")]
    assert [r["text"] for r in chunking.token_windows(df, "id", size=4, overlap=3).orderBy("chunk_index").collect()] == ["One two three.", "One two three. Four five six.", "Four five six. Seven."]
