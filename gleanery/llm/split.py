"""Splitting oversized texts at natural boundaries.

Content-defined chunking: a rolling hash over the code points marks landmarks, each landmark snaps to the
nearest natural boundary, and the cut of a piece is the strongest snapped landmark between the minimum and the
maximum size. Landmarks and snapping depend on the text around them alone, so an edit alters only the pieces
near it; the cuts further on fall together again.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_batches
from gleanery.llm.sentences import segment

#: Code points in the rolling hash, and the mean distance of its landmarks.
WINDOW, SPACING = 16, 32
#: How far a landmark may move to a boundary of each class: unit (paragraph, line, sentence), clause, white space.
REACH = (160, 60, 30)
_POWERS = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(WINDOW)], np.uint32)
_CLAUSE = re.compile(r"[,;:，；：、،؛)\]）」”]\s*")
_SPACE = re.compile(r"\s+")


def landmarks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after which the rolling hash of the last ``WINDOW`` code points is a landmark, and their hashes."""
    n = len(codes)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    h = np.zeros(n - WINDOW + 1, np.uint32)
    for k in range(WINDOW):
        h += codes[WINDOW - 1 - k : n - k] * _POWERS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    at = np.flatnonzero(h % np.uint32(SPACING) == 0)
    return at + WINDOW, h[at]


def _whole(text: str, i: int, least: int) -> int:
    """``i`` moved back so that no letter is parted from its marks or joiners."""
    while i > least and (unicodedata.category(text[i])[0] == "M" or text[i] in "\u200d\u200c\ufe0f" or text[i - 1] == "\u200d"):
        i -= 1
    return i


def pieces(text: str | None, limit: int = 1300, overlap: int = 300, least: int | None = None) -> list[tuple[int, int]]:
    """Places (start, end) of the pieces of ``text``: each at most ``limit`` long, neighbours sharing up to ``overlap``.

    A text within the limit is one piece, an empty or null one none. Together the pieces cover the text.
    """
    if not text:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    most = limit - overlap
    least = min(most, max(1, most * 2 // 5 if least is None else least))
    units = segment(text)
    level = np.zeros(n + 1, np.int8)  # class of the boundary before each place: 3 unit, 2 clause, 1 white space
    for m in _SPACE.finditer(text):
        level[m.end()] = 1
    for m in _CLAUSE.finditer(text):
        level[m.end()] = max(level[m.end()], 2) if m.end() < n and text[m.end() - 1].isspace() or m.group()[0] in "，；：、" else level[m.end()]
    for (_, a), (b, _) in zip(units, units[1:]):
        level[b] = 4 if text.count("\n", a, b) else 3
    level[0] = level[n] = 0
    grades = [np.flatnonzero(level >= 3), np.flatnonzero(level == 2), np.flatnonzero(level == 1)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks, hashes = landmarks(codes)
    snapped: dict[int, tuple[int, int]] = {}  # place -> strength, hash
    for place, h in zip(marks.tolist(), hashes.tolist()):
        for grade, reach in zip(grades, REACH):
            if len(grade):
                k = int(np.searchsorted(grade, place))
                near = min((int(x) for x in grade[max(0, k - 1) : k + 1]), key=lambda x: (abs(x - place), x))
                if abs(near - place) <= reach:
                    key = (-int(level[near]), h)
                    snapped[near] = min(snapped.get(near, key), key)
                    break
        else:
            snapped.setdefault(_whole(text, place, 1) if place < n else place, (0, h))
    places = np.array(sorted(x for x in snapped if 0 < x < n), np.int64)
    cuts, s = [0], 0
    while n - s > most:
        lo, hi = np.searchsorted(places, [s + least, s + most + 1])
        inside = places[lo:hi].tolist()
        if inside:
            cut = min(inside, key=lambda x: (snapped[x], x))
        else:
            cut = s + most
            for grade in grades:
                k = int(np.searchsorted(grade, cut, "right")) - 1
                if k >= 0 and grade[k] >= s + least:
                    cut = int(grade[k])
                    break
            cut = _whole(text, cut, s + 1)
        cuts.append(cut)
        s = cut
    cuts.append(n)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        start = a
        if a and overlap:
            earliest = max(out[-1][0] + 1, a - overlap)  # never the whole of the piece before
            for grade in grades:
                k = int(np.searchsorted(grade, earliest))
                if k < len(grade) and grade[k] < a:
                    start = int(grade[k])
                    break
            else:
                start = earliest
                while start < a and (unicodedata.category(text[start])[0] == "M" or text[start] in "\u200d\u200c\ufe0f"):
                    start += 1
        out.append((start, b))
    return out


def split_oversized(df: DataFrame, limit: int = 1300, overlap: int = 300, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text longer than ``limit`` code points.

    Columns: the id, ``piece_index`` from 0, ``start_pos``, ``end_pos`` (end exclusive, in code points of the text),
    ``text`` (the piece) and ``char_count`` (its length). The length is measured, never read from a column.
    Rows equal in id and text count once; a null id is kept. Null, empty and short texts give no rows, an empty
    table none. Only the id and the text are read, so other columns cannot clash.
    """
    large = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.length("body") > limit).dropDuplicates()

    def setup():
        def step(batch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, k, a, b, t[a:b], b - a) for i, t in zip(ids, texts) for k, (a, b) in enumerate(pieces(t, limit, overlap))]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]

        return step

    id_type = df.schema[id_col].dataType.simpleString()
    found = map_batches(large, f"id {id_type}, piece_index int, start_pos int, end_pos int, text string, char_count int", setup)
    return found.withColumnRenamed("id", id_col)
