"""Vectors as arrays of numbers, and sets as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; one of zeros stays."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors."""
    return 1 - dot(a, b)


def similarity_of_squared(distance2: Column) -> Column:
    """Cosine similarity of unit vectors from their squared Euclidean distance."""
    return 1 - distance2 / 2


def similarity_of_reported(distance2: Column) -> Column:
    """The score of the original service, which squares a distance that is squared already; it ranks alike."""
    return 1 - F.pow(distance2, F.lit(2.0)) / 2


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; 0 if that is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
