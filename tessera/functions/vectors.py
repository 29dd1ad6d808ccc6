"""Vectors in arrays: parsing, norms and similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """Array of a vector written as a JSON list; NULL if it isn't one."""
    return F.from_json(text, "array<float>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 for vectors that are NULL, empty or of different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(product, F.lit(0.0))).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Unit vector; elements of a zero vector become NULL."""
    return F.transform(a, lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0)))
