"""Vector expressions; float arrays are widened to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalise(c: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    length = F.greatest(F.sqrt(dot(c, c)), F.lit(1e-12))
    return F.transform(c, lambda x: x.cast("double") / length)
