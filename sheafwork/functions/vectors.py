"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Against one fixed vector: its norm is taken once."""
    size = sum(x * x for x in query) ** 0.5
    return F.try_divide(dot(a, F.array(*[F.lit(float(x)) for x in query])), F.sqrt(dot(a, a)) * F.lit(size))
