"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def match_percent(a: Column, b: Column) -> Column:
    """Cosine as a percentage: (cos + 1) * 50 within 0 and 100."""
    cosine = dot(a, b) / (norm(a) * norm(b) + 1e-9)
    return F.least(F.greatest((cosine + 1) * 50, F.lit(0.0)), F.lit(100.0))


def shifted(user: Column, item: Column, rate: float = 0.3, unit: bool = False) -> Column:
    """user + rate * item, of unit length if asked."""
    moved = F.zip_with(user, item, lambda u, i: u + rate * i)
    return F.transform(moved, lambda x: x / (norm(moved) + 1e-9)) if unit else moved
