"""Evaluation texts that leak into training text, by winnowing.

Words of a text are hashed in runs of ``K``; of every ``WINDOW`` runs in a row the least hash is kept, the last of
equals. Two texts that share ``K + WINDOW - 1`` words in a row keep the same hash for that place, so a join on kept
hashes misses no shared passage of that length. Hits are extended word by word, and count where enough words agree.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_batches

#: Words in a row that make a leak, and words in a run; the window follows.
PASSAGE, K = 12, 6
#: Kept hashes of the evaluation items that may be sent to every task; beyond it they are joined by a shuffle.
BROADCAST_PRINTS = 1_000_000
#: Documents that meet the items of one kept hash in one place.
BLOCK = 4_096

# short ones with anything in them, and those of any length that open like a tag
_TAG = re.compile(r"<[^<>]{0,400}>|<[A-Za-z/!?][^<>]*>")
_REF = re.compile(r"\[\s*\d{1,4}(?:\s*[,;–-]\s*\d{1,4})*\s*\]")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_MARKS = re.compile("[̀-゙゚ͯ]")
_WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def passage_words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without tags, bracketed reference numbers and invisible characters."""
    text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _REF.sub(" ", text)
    if _MARKS.search(text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


class Hashes:
    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def winnow(codes: np.ndarray, passage: int = PASSAGE, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and the word at which their run begins."""
    window = passage - k + 1
    n = len(codes) - k + 1
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs += codes[i : i + n] * _MUL[i]
        runs ^= runs >> np.uint64(31)
    views = np.lib.stride_tricks.sliding_window_view(runs, window)
    at = np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))
    return runs[at], at


def longest_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Words in a row that agree around ``a[i]`` and ``b[j]``: how many, and the first in ``a``."""
    lo = 0
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    most = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + most] != b[j : j + most])
    return lo + (int(differ[0]) if len(differ) else most), i - lo


def leaks(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("question", "expected_answer", "answer"), doc_id: str = "doc_id", text_col: str = "text", item_id: str = "question_id", passage: int = PASSAGE, broadcast_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """Documents that hold ``passage`` or more words in a row of a field of an item.

    One row for each document, item and field: ``doc_id``, ``item_id``, ``field``, ``words`` (the longest shared run).
    Rows with a null id, null and blank texts and empty tables give no rows; repeated rows count once. Texts are read
    whole. Only the columns named are read, so other columns cannot clash.
    """
    if passage < 2:
        raise ValueError("passage must be at least 2 words")
    k = min(K, passage)
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    stacked = items.select(F.col(item_id).alias("item"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f"))
    stacked = stacked.select("item", "f.field", "f.text").where("item IS NOT NULL AND text IS NOT NULL").distinct()
    doc_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc {doc_type}, item {item_type}, field string, words int"

    # a text keeps fewer hashes than it has characters, so this bounds what is sent to the tasks
    size = stacked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    if size["n"] / 4 <= broadcast_prints:
        gold = [(r["item"], r["field"], r["text"]) for r in stacked.collect()]

        def setup():
            h = Hashes()
            codes = [h.of(passage_words(t)) for _, _, t in gold]
            prints, places = [], []
            for g, c in enumerate(codes):
                p, at = winnow(c, passage, k)
                prints.append(p)
                places += [(g, int(x)) for x in at]
            flat = np.concatenate(prints) if prints else np.empty(0, np.uint64)
            at_print: dict[int, list[tuple[int, int]]] = {}
            for p, place in zip(flat.tolist(), places):
                at_print.setdefault(p, []).append(place)
            known = np.array(sorted(at_print), np.uint64)

            def step(batch):
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    c = h.of(passage_words(t))
                    p, at = winnow(c, passage, k)
                    if not len(p) or not len(known):
                        continue
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, p), len(known) - 1)] == p)
                    best: dict[int, int] = {}
                    for x in hit.tolist():
                        for g, j in at_print[int(p[x])]:
                            n, _ = longest_run(c, int(at[x]), codes[g], j)
                            if n >= passage:
                                best[g] = max(best.get(g, 0), n)
                    rows += [(d, gold[g][0], gold[g][1], n) for g, n in best.items()]
                return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(4)]

            return step

        found = map_batches(docs, schema, setup)
    else:
        def prints_of(df: DataFrame, cols: int, ddl: str) -> DataFrame:
            def setup():
                h = Hashes()

                def step(batch):
                    kept = [np.unique(winnow(h.of(passage_words(t)), passage, k)[0]).view(np.int64).tolist() for t in batch.column(cols).to_pylist()]
                    return [*(batch.column(c) for c in range(cols)), kept]

                return step

            return map_batches(df, ddl + ", prints array<long>", setup)

        left = prints_of(docs, 1, f"doc {doc_type}").select("doc", F.explode("prints").alias("print"))
        right = prints_of(stacked, 2, f"item {item_type}, field string").select("item", "field", F.explode("prints").alias("print"))
        # only hashes that both sides keep go on; documents of a hash that very many have meet its items in blocks
        left = left.join(right.select("print").distinct(), "print", "left_semi")
        sizes = left.groupBy("print").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        left = left.join(sizes, "print").select("doc", "print", F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("block"))
        right = right.join(sizes, "print").select("item", "field", "print", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        pairs = left.join(right, ["print", "block"]).select("doc", "item", "field").distinct()
        texts = pairs.join(docs, "doc").join(stacked.withColumnRenamed("text", "gold"), ["item", "field"]).select("doc", "item", "field", "text", "gold")

        def verify():
            h = Hashes()

            def step(batch):
                rows = []
                for d, i, f, t, g in zip(*(batch.column(c).to_pylist() for c in range(5))):
                    a, b = h.of(passage_words(t)), h.of(passage_words(g))
                    (p, at), (q, where) = winnow(a, passage, k), winnow(b, passage, k)
                    n, seen = 0, {}
                    for v, y in zip(q.tolist(), where.tolist()):
                        seen.setdefault(v, []).append(y)
                    for u, x in zip(p.tolist(), at.tolist()):
                        for y in seen.get(u, ()):
                            n = max(n, longest_run(a, x, b, y)[0])
                    if n >= passage:
                        rows.append((d, i, f, n))
                return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(4)]

            return step

        found = map_batches(texts, schema, verify)
    best = found.groupBy("doc", "item", "field").agg(F.max("words").alias("words"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "field", "words")
