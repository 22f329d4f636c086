"""Vector arithmetic on arrays, in double precision and in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0, null if either vector is."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def normalized(a: Column) -> Column:
    """The vector over its length, with 1e-8 added to keep zero vectors whole."""
    n = norm(a) + F.lit(1e-8)
    return F.transform(a.cast("array<double>"), lambda x: x / n)
