"""Exact nearest neighbours by cosine, for a batch of query vectors.

Queries go out in a bounded number; every task multiplies them, block by block, with its part of the corpus and keeps the
best of each query, so that what is shuffled grows with the queries and the tasks, not with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.operators.best import Best
from gleanery.session import cut, map_arrow

#: Query vectors of one product, and those sent to the tasks at once (768 bytes each at 96 numbers).
BLOCK, SENT = 2_048, 65_536
#: Rows of the corpus in one product, what a cosine may be off by before it is rounded, and tasks for each core.
ROWS, SLACK, TASKS = 1_024, 2e-6, 3


def predicate(where: dict, field: str | None = None) -> Column:
    """A filter on metadata as a column: ``$eq $ne $gt $gte $lt $lte $in $nin $and $or``, ``$contains $not_contains``."""
    out: Column | None = None
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = [predicate(x) for x in value]
            one = parts[0]
            for p in parts[1:]:
                one = one & p if key == "$and" else one | p
        elif key.startswith("$"):
            c = F.col(field)
            one = {"$eq": lambda: c == value, "$ne": lambda: c != value, "$gt": lambda: c > value, "$gte": lambda: c >= value, "$lt": lambda: c < value, "$lte": lambda: c <= value, "$in": lambda: c.isin(list(value)), "$nin": lambda: ~c.isin(list(value)), "$contains": lambda: c.contains(value), "$not_contains": lambda: ~c.contains(value)}[key]()
        elif isinstance(value, dict):
            one = predicate(value, key)
        else:
            one = F.col(key) == value
        out = one if out is None else out & one
    return F.lit(True) if out is None else out


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    at = np.flatnonzero((np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[:-1][at][:, None] + np.arange(dim)] if len(at) else np.empty((0, dim))
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    x, at = x[ok], at[ok]
    return at, x / np.linalg.norm(x, axis=1, keepdims=True)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5, dim: int = 96, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str | None = None, query_col: str | None = None, where: dict | Column | None = None, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``id``, ``rank`` and ``distance`` (1 - cosine, to 6 places) of the ``k`` nearest of each query.

    Rows without a usable vector (exactly ``dim`` finite numbers, not all zero) take no part. ``where`` filters the corpus
    before ranking. Ties go to the lesser id. A query vector that stands in the corpus finds itself.
    """
    query_id, query_col = query_id or id_col, query_col or vec_col
    if where is not None:
        corpus = corpus.where(predicate(where) if isinstance(where, dict) else where)
    src = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    kinds = corpus.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    rows = asked.limit(SENT + 1).toArrow()
    sent = [rows]
    if rows.num_rows > SENT:  # each part of a larger set scans the corpus once
        asked = cut(asked)
        parts = -(-asked.count() // SENT)
        sent = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow() for p in range(parts))
    spark = corpus.sparkSession
    src = src.coalesce(TASKS * spark.sparkContext.defaultParallelism)  # what comes out grows with the tasks
    found = None
    for rows in sent:
        at, q = _unit(rows.column("v"), dim)
        ids = rows.column("query_id").combine_chunks().take(pa.array(at))
        out = map_arrow(src, _nearest(spark.sparkContext.broadcast((ids, q)), k, dim, block), f"query_id {kinds[1]}, id {kinds[0]}, distance double")
        found = out if found is None else found.union(out)
    by = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "id", "rank", "distance")


def _nearest(sent, k: int, dim: int, block: int):
    """The nearest ``k`` of each query among the rows of a task."""

    def run(batches):
        q_ids, unit = sent.value
        n = len(unit)
        best = [Best(len(unit[b : b + block]), k) for b in range(0, n, block)]
        for batch in batches:
            at, x = _unit(batch.column(1), dim)
            if not len(x) or not n:
                continue
            names = batch.column(0).take(pa.array(at))
            # ties by id: a stable order by id, then the least distances
            order = np.array(pc.sort_indices(names))
            names, x = names.take(pa.array(order)), x[order]
            for a in range(0, len(x), ROWS):
                ids = names.slice(a, ROWS)
                for b, found in enumerate(best):
                    near = unit[b * block : (b + 1) * block] @ x[a : a + ROWS].T
                    # a query that has k is only concerned by those that are as near as its last
                    row, t = np.nonzero(near >= 1 - SLACK - found.bar[:, None])
                    if len(t) > 4 * k * len(near):
                        s = np.round(1 - near, 6)
                        t = np.argsort(s, axis=1, kind="stable")[:, :k]
                        row, t = np.repeat(np.arange(len(t)), t.shape[1]), t.ravel()
                    d = np.round(1 - near[row, t], 6) + 0.0  # no negative zero
                    good = d <= found.bar[row]
                    found.add(row[good], d[good], ids.take(pa.array(t[good])))
        for b, found in enumerate(best):
            found.merge()
            for row, d, ids in found.held:
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row + b * block)), ids, pa.array(d)], names=["query_id", "id", "distance"])

    return run
