"""Vector expressions on ``array<float>``; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 for the same direction; null when a vector is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def has_dimension(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))
