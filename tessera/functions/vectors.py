"""Array<double> arithmetic as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A segment shorter than this (squared) is a point.
DEGENERATE = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def sq_dist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def axpy(a: Column, t: Column, b: Column) -> Column:
    """a + t * b"""
    return F.zip_with(a, b, lambda x, y: x + t * y)


def as_doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def segment_fields(x: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """(distance, t) of a point to the segment u-v: the clipped projection and the distance of its
    three cases; a degenerate segment is its first end."""
    num, ww = dot(minus(x, u), minus(v, u)), sq_dist(u, v)
    flat = ww < DEGENERATE
    raw = F.when(flat, F.lit(0.0)).otherwise(num / F.when(flat, F.lit(1.0)).otherwise(ww))
    inside = sq_dist(x, u) - num * num / F.when(flat, F.lit(1.0)).otherwise(ww)
    d2 = F.when(raw <= 0, sq_dist(x, u)).when(raw >= 1, sq_dist(x, v)).otherwise(inside)
    return F.sqrt(F.greatest(d2, F.lit(0.0))), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def mean_vector(x: Column, dims: int) -> Column:
    """Aggregate: the mean of an array column, one built-in average a dimension."""
    return F.array(*[F.avg(x[i]) for i in range(dims)])
