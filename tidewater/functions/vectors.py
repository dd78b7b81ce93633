"""Vectors in arrays, by the JVM's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in the order of the entries."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, kind: str = "l2") -> Column:
    """l2: squared Euclidean; cos: 2 - 2 a.b, for vectors of unit length."""
    if kind == "l2":
        return squared_distance(a, b)
    if kind == "cos":
        return F.lit(2.0) - F.lit(2.0) * dot(a, b)
    raise ValueError(f"unknown distance {kind!r}")


def euclidean(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Euclidean distance; eps is added to each difference, as some libraries do."""
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y + F.lit(eps)) * (x - y + F.lit(eps))), F.lit(0.0), lambda s, x: s + x))


def argmax(v: Column) -> Column:
    """Place of the largest entry, from 0; the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def reflect_padded(v: Column, size: int) -> Column:
    """v to `size` entries by appending it backwards; at most twice its length."""
    return F.when(F.size(v) >= size, F.slice(v, 1, size)).otherwise(F.slice(F.concat(v, F.reverse(v)), 1, size))


def equal_windows(v: Column, size: int) -> Column:
    """v in windows of `size` entries; what is left over goes."""
    n = F.floor(F.size(v) / F.lit(size)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(v, i * size + 1, size))
