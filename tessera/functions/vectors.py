"""Dense and sparse vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector is unchanged."""
    size = norm(a)
    return F.when(size > 0, F.zip_with(a, F.array_repeat(size, F.size(a)), lambda x, n: x.cast("double") / n)).otherwise(a.cast("array<double>"))


#: Measure -> (score, whether more is nearer).
MEASURES = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclidean, False)}


def sparse_ok(v: Column) -> Column:
    """Whether a sparse vector has as many values as indices, no index twice, and none below zero."""
    indices, values = v.getField("indices"), v.getField("values")
    return (F.size(indices) == F.size(values)) & (F.size(F.array_distinct(indices)) == F.size(indices)) & F.forall(indices, lambda i: i >= 0)
