"""Scores of ranked hits against gold labels, and means of judge scores."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.providers import Judge, OverlapJudge
from gleanery.session import cut, map_arrow


def all_gold(*lists: str) -> Column:
    """The distinct ids of several lists, in order; null lists and empty ids are left out."""
    return F.filter(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists]))), lambda x: x.isNotNull() & (x != ""))


def per_question(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = ("strategy",), kinds: tuple[str, ...] = (), strategies: list[str] | None = None) -> DataFrame:
    """Of each question and strategy: ``first_rank`` of a gold id (null if none), ``hit_at_k`` for each k and ``rr``.

    ``hits``: ``query_id``, ``id``, ``rank`` and the columns ``by``. ``gold``: ``query_id``, ``gold`` (array) and the columns ``kinds``, where a
    question has several lists of gold. A question without gold ids, or without hits, counts with zeros for every
    strategy that answers any question, or for all of ``strategies`` where they are named.
    """
    keys = [*kinds, *by]
    wanted = gold.select("query_id", *kinds, F.explode("gold").alias("id")).distinct()
    first = hits.join(wanted, ["query_id", "id"]).groupBy("query_id", *keys).agg(F.min("rank").alias("first_rank"))
    every = gold.select("query_id", *kinds).distinct()
    if by and strategies is not None:
        every = every.select("*", F.explode(F.array(*map(F.lit, strategies))).alias(by[0]))
    elif by:
        every = every.crossJoin(F.broadcast(hits.select(*by).distinct()))  # strategies are few
    out = every.join(first, ["query_id", *keys], "left")
    return out.select("query_id", *keys, "first_rank", *[(F.coalesce(F.col("first_rank") <= k, F.lit(False))).cast("int").alias(f"hit_at_{k}") for k in ks], F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def _mean(c: Column | str, places: int) -> Column:
    """A rounded mean that does not hang on the order of its sum: noise below 8 places goes first."""
    return F.round(F.round(F.avg(c), 8), places)


def summarise(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Of each strategy: questions, ``recall_at_k`` (share of questions with a gold hit up to k) and ``mrr``, to 4 places, and
    ``mean_latency_ms`` to 2 where the scores have ``latency_ms``."""
    late = [F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms")] if "latency_ms" in scores.columns else []
    return scores.groupBy(*by).agg(F.count("*").alias("n_questions"), *[_mean(f"hit_at_{k}", 4).alias(f"recall_at_{k}") for k in ks], _mean("rr", 4).alias("mrr"), *late)


def evaluate(retrievers: dict[str, Callable[[DataFrame], DataFrame]], questions: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), lists=None) -> tuple[DataFrame, DataFrame]:
    """Runs each retriever over all questions: results and summary.

    ``questions``: ``query_id``, ``query`` and what the retrievers read. ``gold``: ``query_id``, ``gold``, ``prime`` (arrays). Results, one row a
    strategy and question: ``strategy``, ``query_id``, ``query``, ``hit_ids``, ``gold``, ``prime``, ``latency_ms`` (of the whole batch, shared
    by its questions) and the scores. Summary, one row a strategy: the scores for any gold id, ``primary_...`` for
    primary ones, and ``mean_latency_ms``. A question without gold ids scores 0. ``lists``: the ``rerank.Lists`` that the retrievers
    share, if they do; each strategy's latency holds what its lists took, whoever asked first.
    """
    n = questions.count()
    parts = []
    for name, run in retrievers.items():
        began, again = time.perf_counter(), lists.again if lists else 0
        hits = cut(run(questions).select("query_id", "id", "rank"))
        took = time.perf_counter() - began + (lists.again - again if lists else 0)
        parts.append(hits.select(F.lit(name).alias("strategy"), "*", F.lit(1000 * took / max(n, 1)).alias("latency_ms")))
    hits = reduce(DataFrame.union, parts)
    ids = hits.groupBy("strategy", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hit_ids"))
    names = list(retrievers)
    late = hits.groupBy("strategy").agg(F.max("latency_ms").alias("latency_ms"))
    both = gold.select("query_id", F.lit("any").alias("kind"), "gold").union(gold.select("query_id", F.lit("primary"), "prime"))
    scores = per_question(hits, both, ks, kinds=("kind",), strategies=names)
    any_, prime = scores.where("kind = 'any'").drop("kind"), scores.where("kind = 'primary'").drop("kind")
    results = any_.join(questions.select("query_id", "query"), "query_id").join(gold.select("query_id", "gold", "prime"), "query_id").join(ids, ["strategy", "query_id"], "left").join(F.broadcast(late), "strategy", "left")  # late: one row a strategy
    results = results.select("strategy", "query_id", "query", F.coalesce("hit_ids", F.array().cast(ids.schema["hit_ids"].dataType)).alias("hit_ids"), "gold", "prime", "latency_ms", "first_rank", *[f"hit_at_{k}" for k in ks], "rr")
    one, two = summarise(any_, ks), summarise(prime, ks).drop("n_questions")
    summary = one.join(two.withColumnsRenamed({c: f"primary_{c}" for c in two.columns if c != "strategy"}), "strategy").join(late.select("strategy", F.round("latency_ms", 2).alias("mean_latency_ms")), "strategy", "left")
    return results, summary


def fingerprint_hits(hits: DataFrame, gold_texts: DataFrame, window: int = 400) -> DataFrame:
    """``query_id``, ``first_rank`` of a hit whose first ``window`` characters hold the fingerprint of a gold text, and ``rr``.

    Missing gold texts are passed over; one of white space alone has an empty fingerprint, which every hit holds.
    """
    g = gold_texts.where(F.coalesce(F.col("gold_text"), F.lit("")) != "").select("query_id", T.fingerprint("gold_text").alias("mark"))
    found = hits.join(g, "query_id").where(F.left("text", F.lit(window)).contains(F.col("mark"))).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return gold_texts.select("query_id").distinct().join(found, "query_id", "left").select("query_id", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def judge_means(results: DataFrame, metrics: dict[str, Column], latency: Column | None = None) -> DataFrame:
    """One row: means of the metrics over rows where they are known (null and NaN are not), to 4 places, and of the latency."""
    aggs = [_mean(F.when(~F.isnan(c), c), 4).alias(name) for name, c in metrics.items()]
    if latency is not None:
        aggs.append(F.round(F.avg(latency), 1).alias("mean_latency_ms"))
    return results.agg(F.count("*").alias("n_questions"), *aggs)


def judge_results(records: DataFrame, make: Callable[[], Judge] = OverlapJudge, id_col: str = "query_id") -> DataFrame:
    """``id_col`` and one column for each metric of the judge, to 4 places.

    ``records``: ``id_col``, ``question``, ``answer``, ``contexts`` (array) and, if the judge reads it, ``ground_truth``. A metric that the judge
    cannot give, that is NaN, or whose row makes the judge fail, is null and so left out of means.
    """
    names = list(make().metrics)
    truth = F.col("ground_truth") if "ground_truth" in records.columns else F.lit(None)
    src = records.select(id_col, F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"), F.col("contexts").cast("array<string>").alias("contexts"), truth.cast("string").alias("ground_truth"))
    kind = records.schema[id_col].dataType.simpleString()

    def known(x):
        return None if x is None or math.isnan(x) else math.floor(x * 1e4 + 0.5) / 1e4

    def run(batches):
        judge = make()
        for batch in batches:
            rows = [tuple(r.values())[1:] for r in batch.to_pylist()]
            try:
                scores = judge.judge(rows)
            except Exception:  # one bad row must not cost the others their scores
                scores = []
                for row in rows:
                    try:
                        scores += judge.judge([row])
                    except Exception:
                        scores.append({})
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([known(s.get(m)) for s in scores], pa.float64()) for m in names]], names=[id_col, *names])

    return map_arrow(src, run, f"{id_col} {kind}, " + ", ".join(f"{m} double" for m in names))


def spans(chunks: DataFrame, id_col: str = "id", text_col: str = "text", skip: int = 40, words: int = 14, least: int = 25) -> DataFrame:
    """Queries cut from texts: ``words`` words in a row from behind the first ``skip`` characters, at a place drawn by the hash
    of the id. ``query_id``, ``query``. Texts with fewer than ``least`` words there give none."""
    w = T.words(F.substring(F.col(text_col), skip + 1, 2_000_000_000))
    src = chunks.select(F.col(id_col).alias("query_id"), w.alias("w")).where(F.size("w") >= least)
    place = F.pmod(F.conv(F.left(F.md5(F.col("query_id").cast("string")), F.lit(6)), 16, 10).cast("int"), F.size("w") - 19)
    return src.select("query_id", F.array_join(F.slice("w", place + 1, F.lit(words)), " ").alias("query"))


def overlap(hits: DataFrame, first: str, second: str, k: int = 5) -> DataFrame:
    """``query_id`` and the Jaccard similarity of the ``k`` best ids of two strategies."""
    top = hits.where(F.col("rank") <= k)
    ids = top.groupBy("query_id").agg(F.collect_set(F.when(F.col("strategy") == first, F.col("id"))).alias("a"), F.collect_set(F.when(F.col("strategy") == second, F.col("id"))).alias("b"))
    return ids.select("query_id", T.jaccard(F.col("a"), F.col("b")).alias("jaccard"))
