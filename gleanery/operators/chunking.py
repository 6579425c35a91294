"""Chunking strategies: sentence packing with overlap, paragraph-sentence splitting, and breaks at changes of wording.

Each is a fold over the sentences of a section, written with higher-order functions, so that the plan is one
projection and one generator without a shuffle. ``arrow_*`` variants do the same in Python for very long sections.
A null or blank text gives no chunks. A sentence above the limit stays whole unless stated otherwise.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import map_arrow

from gleanery.functions import text as T

FIXED_SIZE, FIXED_OVERLAP = 1200, 300
RECURSIVE_SIZE = 1200
SEMANTIC_MIN, SEMANTIC_MAX, SEMANTIC_BREAK = 700, 1300, 0.18


def _joined(c: Column) -> Column:
    return F.array_join(c, " ")


def _none() -> Column:
    return F.array().cast("array<string>")


def fixed_size(text: Column | str, size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP) -> Column:
    """Sentences packed up to ``size``; each chunk begins with the last sentences of the one before, up to ``overlap``."""
    start = F.struct(_none().alias("done"), _none().alias("cur"), F.lit(0).alias("n"))

    def tail(cur: Column) -> Column:
        """How many of the last sentences fit into the overlap, and their characters when joined: one walk from the end."""
        none = F.struct(F.lit(0).alias("k"), F.lit(-1).alias("n"), F.lit(True).alias("open"))

        def back(acc: Column, s: Column) -> Column:
            n = acc["n"] + 1 + F.length(s)
            fits = acc["open"] & (n <= overlap)
            return F.struct(F.when(fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.when(fits, n).otherwise(acc["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(cur), none, back)

    def step(state: Column, s: Column) -> Column:
        cur, n = state["cur"], state["n"]
        room = n + F.length(s) + F.when(F.size(cur) > 0, 1).otherwise(0) <= size
        packed = F.struct(state["done"].alias("done"), F.concat(cur, F.array(s)).alias("cur"), (n + F.length(s) + F.when(F.size(cur) > 0, 1).otherwise(0)).alias("n"))
        done = F.when(F.size(cur) > 0, F.concat(state["done"], F.array(_joined(cur)))).otherwise(state["done"])
        begun = F.transform(F.array(tail(cur)), lambda t: F.struct(done.alias("done"), F.concat(F.slice(cur, F.size(cur) - t["k"] + 1, t["k"]), F.array(s)).alias("cur"), (t["n"] + 1 + F.length(s)).alias("n")))
        return F.when(room, packed).otherwise(begun[0])

    return F.aggregate(T.sentences(text), start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(_joined(s["cur"])))).otherwise(s["done"]))


def _packed(text: Column, size: int) -> Column:
    start = F.struct(_none().alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(state: Column, s: Column) -> Column:
        cur = state["cur"]
        longer = F.when(cur.isNull(), s).otherwise(F.concat_ws(" ", cur, s))
        return F.when(F.length(longer) <= size, F.struct(state["done"].alias("done"), longer.alias("cur"))).otherwise(F.struct(F.when(cur.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(cur))).alias("done"), s.alias("cur")))

    return F.aggregate(T.sentences(text), start, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def _hard(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))), lambda i: T.trim_ws(F.substring(text, i * size + 1, F.lit(size))))


def _long(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, F.array(T.trim_ws(text))).when(F.size(T.sentences(text)) > 1, _packed(text, size)).otherwise(_hard(text, size))


def recursive(text: Column | str, size: int = RECURSIVE_SIZE) -> Column:
    """The text whole if it fits; else its paragraphs, packed sentences of a longer one, and cuts of a longer sentence."""
    c = T._c(text)
    by_paragraph = F.flatten(F.transform(T.paragraphs(c), lambda p: _long(p, size)))
    pieces = F.when(F.length(c) <= size, F.array(T.trim_ws(c))).when(F.size(T.paragraphs(c)) > 1, by_paragraph).otherwise(_long(c, size))
    return F.filter(pieces, lambda x: x != "")


def semantic(text: Column | str, least: int = SEMANTIC_MIN, most: int = SEMANTIC_MAX, threshold: float = SEMANTIC_BREAK) -> Column:
    """A chunk ends before a sentence that would make it longer than ``most``, or, from ``least`` on, before one whose
    words have a Jaccard similarity below ``threshold`` with those of the chunk."""
    start = F.struct(_none().alias("done"), F.lit(None).cast("string").alias("cur"), _none().alias("seen"))

    def step(state: Column, s: Column) -> Column:
        cur, tokens = state["cur"], T.token_set(s)
        apart = (F.length(cur) + 1 + F.length(s) > most) | ((F.length(cur) >= least) & (T.jaccard(state["seen"], tokens) < threshold))
        return (
            F.when(cur.isNull(), F.struct(state["done"].alias("done"), s.alias("cur"), tokens.alias("seen")))
            .when(apart, F.struct(F.concat(state["done"], F.array(cur)).alias("done"), s.alias("cur"), tokens.alias("seen")))
            .otherwise(F.struct(state["done"].alias("done"), F.concat_ws(" ", cur, s).alias("cur"), F.array_union(state["seen"], tokens).alias("seen")))
        )

    return F.aggregate(T.sentences(text), start, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


STRATEGIES = {"fixed": fixed_size, "fixed_size": fixed_size, "recursive": recursive, "recursive_hierarchical": recursive, "semantic": semantic}


def chunk(sections: DataFrame, strategy: str, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Chunk rows of sections (``source_file``, ``part``, ``item``, ``title``, ``text``): ``chunk_id``, ``text``, ``metadata``.

    ``keep`` names further columns to carry along. Chunks are numbered from 1 within a section.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    pieces = STRATEGIES[strategy]("text", **options)
    rows = sections.select(*keep, "source_file", "part", "item", "title", F.posexplode(pieces).alias("at", "piece")).where("piece <> ''")
    index = (F.col("at") + 1).cast("int")
    name = {"fixed": "fixed_size", "recursive_hierarchical": "recursive"}.get(strategy, strategy)
    metadata = F.struct("source_file", "part", "item", F.col("title").alias("section_title"), F.lit(name).alias("chunk_strategy"), index.alias("chunk_index"), F.length("piece").alias("char_count"), T.token_count("piece").alias("token_count"))
    return rows.select(*keep, T.chunk_id("source_file", "item", index).alias("chunk_id"), F.col("piece").alias("text"), metadata.alias("metadata"))


# -- the same folds in Python, over Arrow batches -------------------------------------------------------------------

_PY_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PY_WORD = re.compile(r"\b[\w'-]+\b")


def py_sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _PY_SENTENCE.split(text.strip())) if s]


def py_semantic(text: str, least: int = SEMANTIC_MIN, most: int = SEMANTIC_MAX, threshold: float = SEMANTIC_BREAK) -> list[str]:
    out: list[str] = []
    cur, seen = "", set()
    for s in py_sentences(text):
        tokens = {w.lower() for w in _PY_WORD.findall(s)}
        union = seen | tokens
        similar = len(seen & tokens) / len(union) if union else 1.0
        if cur and (len(cur) + 1 + len(s) > most or len(cur) >= least and similar < threshold):
            out.append(cur)
            cur, seen = s, tokens
        else:
            cur, seen = f"{cur} {s}" if cur else s, union
    return [*out, cur] if cur else out


def arrow_semantic(sections: DataFrame, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """``semantic`` by Arrow batches: the id, ``chunk_index`` from 1 and ``text``."""
    kind = sections.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, at, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, piece in enumerate(py_semantic(t, **options) if t else [], 1):
                    ids.append(i)
                    at.append(k)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "chunk_index", "text"])

    return map_arrow(sections.select(id_col, text_col), run, f"{id_col} {kind}, chunk_index int, text string")


def token_windows(sections: DataFrame, id_col: str, text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """Sentences packed by words rather than characters: up to ``size`` words, the last sentences of up to ``overlap``
    words repeated. The counter is ``token_count``; the splitter of the second engine counts with a tokenizer of its own."""
    kind = sections.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, at, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces, cur, n = [], [], 0
                for s in py_sentences(t) if t else []:
                    k = len(_PY_WORD.findall(s))
                    if cur and n + k > size:
                        pieces.append(" ".join(x for x, _ in cur))
                        tail, left = [], overlap
                        for x, m in reversed(cur):
                            if m > left:
                                break
                            tail.insert(0, (x, m))
                            left -= m
                        cur, n = tail, sum(m for _, m in tail)
                    cur.append((s, k))
                    n += k
                if cur:
                    pieces.append(" ".join(x for x, _ in cur))
                for j, piece in enumerate(pieces):
                    ids.append(i)
                    at.append(j)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "chunk_index", "text"])

    return map_arrow(sections.select(id_col, text_col), run, f"{id_col} {kind}, chunk_index int, text string")
