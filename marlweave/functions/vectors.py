"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    length = F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length == 0, F.lit(1e-9)).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def minmax(score: str, by: str = "query_id") -> Column:
    """A score put on [0, 1] within its query; a query of equal scores gets 0."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (F.col(score) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
