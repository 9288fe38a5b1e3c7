"""Vector functions as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Sum of products; elements missing on the right count 0."""
    pairs = F.zip_with(left, F.slice(right, F.lit(1), F.size(left)), lambda a, b: a * F.coalesce(b, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; null when it is null, empty, zero or not finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    divided = F.transform(F.array(length), lambda n: F.transform(vector, lambda v: v / n))  # the length is bound once, not per element
    return F.when((F.size(vector) > 0) & finite & (length > 0), F.get(divided, F.lit(0)))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when either is not usable or their lengths differ."""
    return F.when(F.size(left) == F.size(right), F.coalesce(dot(unit(left), unit(right)), F.lit(0.0))).otherwise(0.0)
