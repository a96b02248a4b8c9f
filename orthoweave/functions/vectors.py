"""Vector expressions over array columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_eps(a: Column, eps: float = 1e-12) -> Column:
    """a / (|a| + eps): a zero vector stays zero."""
    return F.transform(a, lambda x: x / (norm(a) + F.lit(eps)))


def l2_unit(a: Column) -> Column:
    """a / |a|, a norm of 0 counting as 1."""
    return F.transform(a, lambda x: x / F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a)))


def l2_clamped(a: Column, least: float = 1e-9) -> Column:
    """a / max(|a|, least)."""
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(least)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def zero_filled(a: Column, dim: int) -> Column:
    """The vector, or zeros where it is missing."""
    return F.coalesce(a, F.array_repeat(F.lit(0.0), dim))
