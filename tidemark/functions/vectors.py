"""Vector functions over array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def has_width(a: Column, n: int) -> Column:
    """Fails the job when a vector has another width: a batch with one wrong vector is rejected whole."""
    return F.when(F.size(a) == n, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} dimensions, got "), F.size(a).cast("string"))))
