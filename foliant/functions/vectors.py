"""Vectors as arrays of floats; arithmetic is done in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null where a side is null or all zeros or the sizes differ. Norms may be given if they are at hand."""
    size = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / F.nullif(size, F.lit(0.0)))


def is_valid(a: Column, dimensions: int) -> Column:
    """Whether a vector has so many numbers and no nulls."""
    return F.coalesce((F.size(a) == dimensions) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))


def literal(a: Column) -> Column:
    """The vector as text, in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def constant(value: float, dimensions: int) -> Column:
    return F.array_repeat(F.lit(value).cast("float"), dimensions)


def first_given(*vectors: Column) -> Column:
    """The first vector that is there; an empty one counts as missing."""
    return F.coalesce(*[F.when(F.size(v) > 0, v) for v in vectors])


def blend(similarity: Column, rank: Column, weight: float = 0.8) -> Column:
    """weight of the similarity and the rest of the keyword rank, which counts as 1 at most."""
    return F.lit(weight) * similarity + F.lit(round(1 - weight, 10)) * F.least(rank, F.lit(1.0))
