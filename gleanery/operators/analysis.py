"""Comparisons of strategies, question by question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_matrix(scores: DataFrame, strategies: list[str], k: int = 5) -> DataFrame:
    """One row a question, one column a strategy: whether it hit up to ``k``."""
    return scores.groupBy("query_id").pivot("strategy", strategies).agg(F.max(f"hit_at_{k}"))


def missed_by_all(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.groupBy("query_id").agg(F.max(f"hit_at_{k}").alias("hit")).where("hit = 0").select("query_id")


def won_only_by(scores: DataFrame, strategy: str, k: int = 5) -> DataFrame:
    """Questions that ``strategy`` alone answers up to ``k``."""
    mine, others = F.col("strategy") == strategy, F.col("strategy") != strategy
    hit = F.col(f"hit_at_{k}")
    return scores.groupBy("query_id").agg(F.max(F.when(mine, hit)).alias("mine"), F.max(F.when(others, hit)).alias("others")).where("mine = 1 AND coalesce(others, 0) = 0").select("query_id")


def below(results: DataFrame, column: str, limit: float = 0.8) -> DataFrame:
    return results.where(F.col(column).isNotNull() & (F.col(column) < limit))


# Metrics of a comparison, and the columns to look in, in order; 0 where none has a value.
METRICS = {"r_at_1": ("recall_at_1", "primary_recall_at_1"), "r_at_5": ("recall_at_5", "primary_recall_at_5"), "r_at_10": ("recall_at_10", "primary_recall_at_10"), "mrr": ("mrr",), "ms": ("mean_latency_ms",)}


def compare_versions(first: DataFrame, second: DataFrame, labels: tuple[str, str] = ("v1", "v2"), metrics: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Summaries of two versions under each other: ``label`` (version/strategy), ``version``, ``strategy`` and the metrics.

    A metric comes from the first of its columns that a summary has and that holds a value, or is 0.
    """
    metrics = METRICS if metrics is None else metrics

    def one(df: DataFrame, label: str) -> DataFrame:
        values = [F.coalesce(*[F.col(c).cast("double") for c in columns if c in df.columns], F.lit(0.0)).alias(name) for name, columns in metrics.items()]
        return df.select(F.concat_ws("/", F.lit(label), "strategy").alias("label"), F.lit(label).alias("version"), "strategy", *values)

    return one(first, labels[0]).unionByName(one(second, labels[1]))


def summary_table(summary: DataFrame) -> DataFrame:
    """A summary under the short names of its report: ``strategy``, ``R@1``, ``R@5``, ``R@10``, ``MRR``, then ``ms/q`` where it has latencies."""
    names = {"recall_at_1": "R@1", "recall_at_5": "R@5", "recall_at_10": "R@10", "mrr": "MRR", "mean_latency_ms": "ms/q"}
    return summary.select("strategy", *[F.col(c).alias(n) for c, n in names.items() if c in summary.columns])


def best_by_column(summary: DataFrame, columns: list[str]) -> DataFrame:
    """The summary with ``best_<column>``: whether a row has the greatest value of that column."""
    best = summary.agg(*[F.max(c).alias(f"max_{c}") for c in columns])
    return summary.crossJoin(F.broadcast(best)).select(*summary.columns, *[(F.col(c) == F.col(f"max_{c}")).alias(f"best_{c}") for c in columns])


def common_strategies(first: DataFrame, second: DataFrame, metric: str, strategies: list[str] | None = None) -> DataFrame:
    """``strategy`` and the metric in both versions, 0 where it is unknown: of the strategies that both have, or of those named."""
    a = first.select("strategy", F.coalesce(metric, F.lit(0.0)).alias("first"))
    b = second.select("strategy", F.coalesce(metric, F.lit(0.0)).alias("second"))
    if strategies is None:
        return a.join(b, "strategy")
    both = a.where(F.col("strategy").isin(strategies)).join(b.where(F.col("strategy").isin(strategies)), "strategy", "full")
    return both.select("strategy", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("second", F.lit(0.0)).alias("second"))
