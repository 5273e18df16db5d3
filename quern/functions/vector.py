"""Vector expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for empty, unequal-length, zero or null vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, _sum(F.zip_with(a, b, lambda x, y: x * y)) / norm).otherwise(F.lit(0.0))
