"""Array-of-double columns as vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column, eps: float = 1e-8, mode: str = "add") -> Column:
    """a / (norm + eps), or with mode='clip' a / max(norm, 1e-12)."""
    n = norm(a) + eps if mode == "add" else F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / n)


def scale(a: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), std, lambda d, s: d / s)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def is_finite(a: Column) -> Column:
    """Whether a vector is there, not empty, and holds neither nulls nor NaN nor infinities; never null.

    A search for a value in an array with a null gives null where it does not find it.
    """
    odd = [F.array_contains(a, F.lit(x).cast("double")) for x in (float("nan"), float("inf"), float("-inf"))]
    return F.coalesce(a.isNotNull() & (F.size(a) > 0) & ~odd[0] & ~odd[1] & ~odd[2], F.lit(False))
