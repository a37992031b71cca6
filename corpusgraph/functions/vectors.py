"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """a over its length, which is found once; zeros stay zeros."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))
    return F.when(a.isNotNull(), scaled[0])


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def blend(own: Column, mean: Column, alpha: float) -> Column:
    """normalize(alpha * own + (1 - alpha) * mean); own where there is no mean."""
    mixed = F.zip_with(own, mean, lambda x, y: alpha * x.cast("double") + (1 - alpha) * y)
    return F.when(mean.isNull(), F.transform(own, lambda x: x.cast("double"))).otherwise(l2_normalize(mixed))
