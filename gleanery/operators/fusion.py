"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RRF = 60


def reciprocal_rank(dense: DataFrame, lexical: DataFrame, k: int = 5, pool: int | None = None, rrf: int = RRF, missing_rank: int | None = None, rank_base: int = 1) -> DataFrame:
    """Fuses two lists (``query_id``, ``id``, ``rank`` from 1): ``query_id``, ``id``, ``rank``, ``score`` and the ranks in both.

    Each list is cut to ``pool`` (by default ``k``) first. A score is the sum of 1 / (rrf + rank); a list that lacks the id
    adds nothing, or counts as ``missing_rank``. ``rank_base`` 0 lets ranks begin at 0. Ties: dense rank, then lexical
    rank (missing ones last), then id.
    """
    pool = pool or k
    d = dense.where(F.col("rank") <= pool).select("query_id", "id", F.col("rank").alias("dense_rank"))
    x = lexical.where(F.col("rank") <= pool).select("query_id", "id", F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "id"], "full")

    def part(c):
        shifted = F.col(c) - (1 - rank_base)
        return F.coalesce(1.0 / (rrf + shifted), F.lit(1.0 / (rrf + missing_rank)) if missing_rank is not None else F.lit(0.0))

    scored = both.withColumn("score", F.round(part("dense_rank") + part("lexical_rank"), 9))
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "id", "rank", "score", "dense_rank", "lexical_rank")


def fuse_indexes(lists: dict[str, DataFrame], k: int = 10, pool: int = 8, rrf: int = RRF) -> DataFrame:
    """Fuses the lists of several indexes whose ids may be alike: ``query_id``, ``key`` (name:id), ``rank``, ``score``.

    Ties go to the index named first, then to the better rank.
    """
    union: DataFrame | None = None
    for i, (name, hits) in enumerate(lists.items()):
        one = hits.where(F.col("rank") <= pool).select("query_id", F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("key"), F.lit(i).alias("source"), "rank")
        union = one if union is None else union.union(one)
    scored = union.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (rrf + F.col("rank"))), 9).alias("score"), F.min(F.struct("source", "rank")).alias("first"))
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "first", "key")
    return scored.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "key", "rank", "score")
