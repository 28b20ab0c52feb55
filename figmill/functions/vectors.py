"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """Divided by the length, or by ``least`` where the vector is shorter."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def root_scaled(v: Column, eps: float = 1e-7) -> Column:
    """Square roots of the shares of a non-negative vector's sum."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) + eps
    return F.transform(v, lambda x: F.sqrt(x.cast("double") / total))


def truth(v: Column, above: float | None = None) -> Column:
    """An array as booleans: above a threshold, or not zero."""
    return F.transform(v, lambda x: x > above if above is not None else x != 0)
