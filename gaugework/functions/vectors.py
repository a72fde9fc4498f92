"""Float vectors as array columns: elementwise arithmetic, dot product, reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _elementwise(a: Column, b: Column, f) -> Column:
    """Null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def vec_add(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def vec_mul(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x * y)


def vec_dot(a: Column, b: Column) -> Column:
    """In double precision; 0 where the lengths differ or nothing is in them."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))


def vec_sum(a: Column) -> Column:
    return F.coalesce(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(0.0))


def vec_max(a: Column) -> Column:
    return F.coalesce(F.array_max(a).cast("double"), F.lit(0.0))


def vec_min(a: Column) -> Column:
    return F.coalesce(F.array_min(a).cast("double"), F.lit(0.0))
