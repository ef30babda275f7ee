"""Vectors as array columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths to which nested embeddings may be cut.
NESTED = (32, 64, 128, 256, 512, 768, 1024)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def is_sound(v: Column) -> Column:
    """Not null, finite everywhere and not zero."""
    return v.isNotNull() & ~F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(doubles(v), lambda x: x != 0)


def l2_normalize(v: Column) -> Column:
    """Unit length; null where the vector isn't sound.

    The norm is bound by an outer transform over one value: inside the inner one it would be taken again for each component.
    """
    return F.when(is_sound(v), F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: x / n))[0])


def truncated(v: Column, size: int) -> Column:
    if size not in NESTED:
        raise ValueError(f"size must be one of {NESTED}")
    return l2_normalize(F.slice(v, 1, size))
