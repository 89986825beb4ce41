"""Vector maths as higher-order array functions.

Inputs are ``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``; every product is taken in
DOUBLE so the result does not depend on the storage precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y))


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(as_double_array(a), lambda x: x * x)))


def l2_distance(a, b) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(as_double_array(a), as_double_array(b),
                                  lambda x, y: (x - y) * (x - y))))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector has zero length."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine(a, b)
