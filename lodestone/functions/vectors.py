"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a norm is 0 or a length differs."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), 1 - dot(a, b) / scale)


def shortened(a: Column, dims: int) -> Column:
    """The first dims entries at length 1; a vector that is short enough, or of norm 0, stays as it is."""
    cut = F.slice(a, 1, dims)
    size = norm(cut)
    return F.when(F.size(a) <= dims, a).otherwise(F.when(size > 0, F.transform(cut, lambda x: (x / size).cast("float"))).otherwise(cut))
