"""Arithmetic on ARRAY<DOUBLE> columns, kept inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a - b)


def l2_normalize(vector: Column, floor: float = 1e-12) -> Column:
    """Unit length; the zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(floor))
    return F.transform(vector, lambda x: x / length)


def cosine_similarity(left: Column, right: Column, floor: float = 1e-12) -> Column:
    lengths = F.greatest(norm(left), F.lit(floor)) * F.greatest(norm(right), F.lit(floor))
    return dot(left, right) / lengths


def zeros(size: int) -> Column:
    return F.array(*[F.lit(0.0)] * size)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def linear(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """``W·v + b`` for a given weight matrix (rows = outputs)."""
    offsets = bias or [0.0] * len(weights)
    return F.array(*[dot(vector, literal(row)) + F.lit(float(b)) for row, b in zip(weights, offsets)])


def relu(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0.0)))
