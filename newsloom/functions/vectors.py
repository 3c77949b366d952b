"""Column functions over vectors (arrays of numbers); sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length one; zero vectors stay zero."""
    n = norm(a) + F.lit(1e-10)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(1e-10)) * (norm(b) + F.lit(1e-10)))


def has_size(a: Column, size: int) -> Column:
    return a.isNotNull() & (F.size(a) == size)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors whose mask is not 0, place by place; zeros where there is none."""
    some = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(some, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(some).cast("double"), F.lit(1e-9)))
