"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def fused(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return total
