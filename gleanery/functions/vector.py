"""Vector functions as Spark columns, in double precision. A null, or an array of another length, gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def usable(a: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0), F.lit(False))
