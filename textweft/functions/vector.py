"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a.cast("array<double>"), lambda x: x / norm(a)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def percent(c: Column, digits: int = 2) -> Column:
    return F.round(c * 100, digits)
