"""Vector scalars over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _d(arr: Column) -> Column:
    return arr.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; like the reference it has no length check, so a short ``b`` gives null."""
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; length mismatch -> -1, zero norm -> 0."""
    na, nb = norm(a), norm(b)
    return (
        F.when(F.size(a) != F.size(b), F.lit(-1.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(dot(a, b) / (na * nb))
    )


def euclidean(a: Column, b: Column) -> Column:
    """L2 distance; length mismatch -> +infinity."""
    sq = _sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(F.sqrt(sq))
