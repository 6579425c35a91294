"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans.core import QUERIES, SQL, eval_gold

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all chunks for all gold questions, scored against the gold ids."""
    return eval_gold(spark, sf_dir)
