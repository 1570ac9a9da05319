"""Dense and sparse vector measures with built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0 or the lengths differ, null if a vector is null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def literal(vector: list[float]) -> Column:
    """A query vector as a constant of the plan."""
    return F.array(*[F.lit(float(x)) for x in vector])


def sparse(indices: Column, values: Column) -> Column:
    """map index -> weight: positive weights only, the largest where an index repeats, in order of index."""
    pairs = F.filter(F.arrays_zip(indices.alias("i"), values.alias("v")), lambda p: p["v"] > 0)
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["i"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(pairs, lambda p: p["i"] == k), lambda p: p["v"]))))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps over the indices they share."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(F.transform(shared, lambda k: (a[k] * b[k]).cast("double")), F.lit(0.0), lambda s, x: s + x)
