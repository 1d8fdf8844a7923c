"""Vector column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null for a null, 1 for other lengths and for a vector of length 0. Norms may be given."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), 1.0).when(scale == 0, 1.0).otherwise(1 - _dot(a, b) / scale)


def similarity(distance: Column) -> Column:
    """1 - distance, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def hash_bucket(word: Column, dim: int) -> Column:
    """The bucket of a word, by its md5."""
    return F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("int") % dim


def hash_sign(word: Column) -> Column:
    """1 or -1, by the seventh digit of a word's md5."""
    return F.when(F.substring(F.md5(word), 7, 1) < "8", 1.0).otherwise(-1.0)


def dense_unit(counts: Column, dim: int) -> Column:
    """A map from bucket to count as an array of ``dim`` numbers of length 1."""
    length = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, x: s + x * x))
    at = lambda i: F.coalesce(F.element_at(counts, i), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(length > 0, at(i) / length).otherwise(0.0))
