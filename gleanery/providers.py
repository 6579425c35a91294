"""Models behind small protocols, with deterministic stand-ins that run offline.

A provider maps lists to lists and is made once a Python worker. The stand-ins do not reproduce the quality of hosted
or downloaded models; they make every pipeline runnable and testable.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import map_arrow


# Fixed value: what an answer says where the passages do not hold it.
NOT_FOUND = "The provided context does not contain sufficient information to answer this question."


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    model: str

    def answer(self, system: str, prompts: list[str], max_tokens: int, temperature: float) -> list[tuple[str, int, int]]:
        """Of each prompt the answer, and the tokens read and written."""
        ...


class Judge(Protocol):
    metrics: tuple[str, ...]

    def judge(self, rows: list[tuple[str, str, list[str], str | None]]) -> list[dict[str, float | None]]:
        """Scores of rows of question, answer, contexts and expected answer."""
        ...


class HashEmbedder:
    """Bytes of a chain of SHA-256 digests over the text, as unit vectors."""

    def __init__(self, dim: int = 96) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            digest, raw, turn = hashlib.sha256(text.encode("utf-8")).digest(), b"", 0
            while len(raw) < self.dim:
                raw += digest
                digest = hashlib.sha256(digest + str(turn).encode()).digest()
                turn += 1
            v = np.frombuffer(raw[: self.dim], np.uint8) / 255.0
            n = math.sqrt(float(v @ v)) or 1.0
            out.append((v / n).tolist())
        return out


class OverlapScorer:
    """Share of the distinct query words that a text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            q = set(re.findall(r"\w+", query.lower()))
            out.append(len(q & set(re.findall(r"\w+", text.lower()))) / len(q) if q else 0.0)
        return out


class ExtractiveGenerator:
    """Answers with the first sentence of the first passage, cited. Its tokens are words between white space."""

    model = "extractive"

    def answer(self, system: str, prompts: list[str], max_tokens: int = 1024, temperature: float = 0.0) -> list[tuple[str, int, int]]:
        out = []
        for p in prompts:
            context = p[: p.rfind("\n\n---\n\nQuestion: ")].split(":\n\n", 1)[-1]
            if context.startswith("[1] "):  # a numbered passage has a line of its own above
                context = context.split("\n\n---\n\n", 1)[0].split("\n", 1)[-1]
            first = re.split(r"(?<=[.!?])\s|\n", context.strip(), maxsplit=1)[0].strip()
            words = (f"{first} [1]" if first else NOT_FOUND).split(" ")
            text = " ".join(words[:max_tokens])
            out.append((text, len(system.split()) + len(p.split()), len(text.split())))
        return out


def _words(text: str | None) -> set[str]:
    return set(re.findall(r"\w+", (text or "").lower()))


class OverlapJudge:
    """Shares of words: of the answer in the passages, and of the question in the answer; null for an empty answer."""

    metrics: tuple[str, ...] = ("faithfulness", "relevancy")

    def judge(self, rows: list[tuple[str, str, list[str], str | None]]) -> list[dict[str, float | None]]:
        out = []
        for question, answer, contexts, *_ in rows:
            a, q, c = _words(answer), _words(question), _words(" ".join(x or "" for x in contexts or []))
            out.append({"faithfulness": len(a & c) / len(a) if a else None, "relevancy": len(a & q) / len(q) if a and q else None})
        return out


class OverlapJudgeOfFour(OverlapJudge):
    """The same shares under the names of the four metrics, with ``context_recall``, the share of the expected answer in the
    passages, and ``context_precision``, the share of passages that hold at least half of it; null without one."""

    metrics = ("faithfulness", "answer_relevancy", "context_recall", "context_precision")

    def judge(self, rows: list[tuple[str, str, list[str], str | None]]) -> list[dict[str, float | None]]:
        out = []
        for row, two in zip(rows, super().judge(rows)):
            t, sets = _words(row[3]), [_words(x) for x in row[2] or []]
            every = set().union(*sets)
            recall = len(t & every) / len(t) if t else None
            precision = sum(2 * len(t & s) >= len(t) for s in sets) / len(sets) if t and sets else None
            out.append({"faithfulness": two["faithfulness"], "answer_relevancy": two["relevancy"], "context_recall": recall, "context_precision": precision})
        return out


def embed_column(df: DataFrame, text_col: str, make: Callable[[], Embedder] = HashEmbedder, batch_size: int = 64, out: str = "embedding") -> DataFrame:
    """``df`` with the embedding of its text; blank and null texts are embedded as one space. One model a task."""
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).schema

    def run(batches):
        model = make()
        for batch in batches:
            texts = [(t or "").strip() or " " for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch_size) for v in model.embed(texts[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    return map_arrow(df, run, schema)
