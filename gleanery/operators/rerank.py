"""Reranking of candidates by a scorer of pairs, and the retrievers made of all stages."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.session import cut, map_arrow

from gleanery.operators import dense, fusion, lexical
from gleanery.providers import Embedder, HashEmbedder, OverlapScorer, PairScorer, embed_column


#: Ids of candidates that go out to the texts at most.
SENT = 262_144

STRATEGIES = ("semantic", "bm25", "hybrid", "hybrid_rerank")


def rerank(candidates: DataFrame, k: int = 5, make: Callable[[], PairScorer] = OverlapScorer) -> DataFrame:
    """The best ``k`` of candidates (``query_id``, ``query``, ``id``, ``text``) by the scorer: ``query_id``, ``id``, ``rank``, ``score``.

    Only the candidates reach the scorer. No candidates give no rows; ties go to the lesser id.
    """
    src = candidates.select("query_id", "id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    schema = src.select("query_id", "id").withColumn("score", F.lit(0.0)).schema

    def run(batches):
        scorer = make()
        for batch in batches:
            scores = scorer.score(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return map_arrow(src, run, schema).withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def with_texts(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates with the ``text`` of their ``id``. A bounded number of ids goes out to the corpus, so that only their texts are shuffled."""
    ids, texts = candidates.select("id").distinct(), corpus.select("id", "text")
    if ids.limit(SENT + 1).count() <= SENT:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return candidates.join(texts, "id")


@dataclass
class Lists:
    """Ranked lists that retrievers of one corpus, filter, index and embedder share: each is made once for a set of queries, ``depth`` deep or deeper.

    ``again`` sums up the seconds it took to make the lists that were not made again.
    """

    depth: int
    again: float = 0
    kept: dict[str, tuple[DataFrame, int, DataFrame, float]] = field(default_factory=dict)

    def take(self, kind: str, queries: DataFrame, depth: int, make: Callable[[int], DataFrame]) -> DataFrame:
        """The best ``depth`` of the list that ``make`` gives for a depth."""
        asked, deep, hits, seconds = self.kept.get(kind, (None, 0, None, 0.0))
        if asked is queries and deep >= depth:
            self.again += seconds
        else:
            began, deep = time.perf_counter(), max(depth, self.depth)
            hits = cut(make(deep))
            self.kept[kind] = queries, deep, hits, time.perf_counter() - began
        return hits.where(F.col("rank") <= depth)


def retriever(corpus: DataFrame, strategy: str, k: int = 5, pool: int = 20, embedder: Callable[[], Embedder] = HashEmbedder, scorer: Callable[[], PairScorer] | None = OverlapScorer, dim: int = 96, where: dict | None = None, index: lexical.Index | None = None, missing_rank: int | None = None, rank_base: int = 1, lists: Lists | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from queries (``query_id``, ``query``, optionally ``embedding``) to hits (``query_id``, ``id``, ``rank``, ``score``).

    ``corpus`` has ``id``, ``text`` and ``embedding``. Strategies: ``bm25``, ``semantic``, ``hybrid`` and ``hybrid_rerank``, which
    fuses ``pool`` candidates and lets the scorer choose; without a scorer the best ``k`` of the fused pool come out as they are.
    ``index`` is a BM25 index of the corpus, by default made once when words are first needed. ``missing_rank`` and ``rank_base``
    are those of the fusion. Only the stages a strategy needs are planned. A query must have a word to be embedded. Retrievers
    that are given the same ``lists`` search once for the same queries.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if where:
        corpus = corpus.where(dense.predicate(where))
    made: list[lexical.Index] = [index] if index is not None else []

    def run(queries: DataFrame) -> DataFrame:
        depth = pool if strategy == "hybrid_rerank" else k

        def words() -> DataFrame:
            return lists.take("words", queries, depth, search) if lists else search(depth)

        def vectors() -> DataFrame:
            return lists.take("vectors", queries, depth, nearest) if lists else nearest(depth)

        def search(depth: int) -> DataFrame:
            if not made:
                made.append(lexical.build(corpus, "id", "text"))
            return lexical.search(made[0], queries, depth)

        def nearest(depth: int) -> DataFrame:
            q = queries
            if "embedding" not in q.columns:
                blank = F.coalesce(F.trim("query"), F.lit("")) == ""
                q = q.withColumn("query", F.when(blank, F.raise_error(F.lit("the question is blank"))).otherwise(F.col("query")))
                q = cut(embed_column(q, "query", embedder))  # a model is asked once for all questions
            return dense.knn(corpus, q, depth, dim, "id", "embedding", "query_id", "embedding")

        if strategy == "bm25":
            return words()
        if strategy == "semantic":
            return vectors().select("query_id", "id", "rank", (1 - F.col("distance")).alias("score"))
        fused = fusion.reciprocal_rank(vectors(), words(), depth, missing_rank=missing_rank, rank_base=rank_base)
        if strategy == "hybrid" or scorer is None:
            return fused.where(F.col("rank") <= k).select("query_id", "id", "rank", "score")
        fused = cut(fused.select("query_id", "id"))  # read for its ids and for its rows
        return rerank(with_texts(fused.join(queries.select("query_id", "query"), "query_id"), corpus), k, scorer)

    return run
