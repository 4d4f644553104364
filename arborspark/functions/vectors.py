"""Vector functions as column expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Normalised dot product held within [0, 1]; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.least(F.greatest(dot(a, b) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors moved to [0, 1]."""
    return F.least(F.greatest((dot(a, b) + 1) / 2, F.lit(0.0)), F.lit(1.0))
