"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length."""
    product = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), total(product)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(as_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or the lengths differ."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    # the length in an array of one, so that it is worked out once a vector and not once an element
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(as_doubles(a), lambda x: x / n)).otherwise(as_doubles(a)))
    return F.when(a.isNotNull(), F.get(scaled, F.lit(0)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.transform(minus(a, b), lambda d: d * d))


def softmax(a: Column) -> Column:
    # each step in an array of one, worked out once a vector
    shifted = F.transform(F.array(F.array_max(as_doubles(a))), lambda m: F.transform(as_doubles(a), lambda x: F.exp(x - m)))
    shares = F.transform(shifted, lambda e: F.transform(F.array(total(e)), lambda t: F.transform(e, lambda x: x / t)))
    return F.when(a.isNotNull(), F.get(F.get(shares, F.lit(0)), F.lit(0)))
