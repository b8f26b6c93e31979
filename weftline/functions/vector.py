"""Vector expressions over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_array(v: list[float] | Column) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: list[float] | Column) -> Column:
    """Sum of products in double precision; null if the lengths differ or a part is null."""
    parts = F.zip_with(a, as_array(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: list[float] | Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    b = as_array(b)
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2(a: Column, b: list[float] | Column) -> Column:
    """Euclidean distance in double precision; null if the lengths differ or a part is null."""
    parts = F.zip_with(a, as_array(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
