"""Vector and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision; null where an array is null or lengths differ."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v))


def cosine_eps(a: Column | str, b: Column | str) -> Column:
    """a.b / (|a||b| + 1e-10), 0.5 where one is missing."""
    return F.coalesce(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10), F.lit(0.5))


def round_half_even(c: Column, n: int) -> Column:
    return F.bround(c, n)
