"""Arrays of numbers as vectors, in built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    a, b = doubles(a), doubles(b)
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def argmin(a: Column) -> Column:
    """The place of the first smallest number, from 0."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
