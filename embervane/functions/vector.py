"""Vector expressions of built-in higher-order functions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-30


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is 0."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(TINY))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(TINY)))


def tangential_fraction(a: Column, b: Column) -> Column:
    """The share of the squared displacement that isn't radial, in [0, 1]; null for equal vectors."""
    d = squared_distance(a, b)
    radial = norm(a) - norm(b)
    return F.when(d > 0, F.least(F.greatest((d - radial * radial) / d, F.lit(0.0)), F.lit(1.0)))


def margin(logits: Column, k: int = 1) -> Column:
    """The gap between the k-th and the (k + 1)-th largest; null for shorter arrays."""
    down = F.reverse(F.array_sort(logits))
    return F.when(F.size(logits) > k, F.get(down, F.lit(k - 1)).cast("double") - F.get(down, F.lit(k)))


def differential_fraction(a: Column) -> Column:
    """The squared norm about the mean over the squared norm."""
    mean = total(F.transform(a, lambda x: x.cast("double"))) / F.size(a)
    return total(F.transform(a, lambda x: (x - mean) * (x - mean))) / F.greatest(dot(a, a), F.lit(TINY))
