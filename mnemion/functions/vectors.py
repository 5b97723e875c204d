"""Vector functions as column expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return 1.0 / (1.0 + l2(a, b))


def unit(a: Column) -> Column:
    """a by its norm, which is bound to a name so that it isn't computed anew for each component."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bound(a, lambda w: bound(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x / n).otherwise(x))))
