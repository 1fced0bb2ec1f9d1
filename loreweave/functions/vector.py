"""Vector columns: cosine similarity in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null without one of the vectors, or for vectors of different lengths; 0 for a zero vector."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9)))
