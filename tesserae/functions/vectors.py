"""Vectors as array columns: quantising, dot products, windows' pooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def _doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def rounded(c: Column | str, digits: int) -> Column:
    """To so many digits in doubles, as C and DuckDB do it: scaled, halves away from zero, scaled back.

    `F.round` goes by the shortest decimal instead, which may stand on the other side of a half."""
    return F.round(_col(c) * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def normalize(v: Column | str) -> Column:
    """L2; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / n))


def scale_of(v: Column | str) -> Column:
    """What one code unit is worth, in double precision; 1 for a zero vector."""
    top = F.array_max(F.transform(_doubles(v), F.abs))
    return F.when(top > 0, top / 127).otherwise(F.lit(1.0))


def codes_of(v: Column | str) -> Column:
    """Codes -127..127, halves rounded up."""
    s = scale_of(v)
    return F.transform(_doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / s + 0.5))).cast("tinyint"))


def dequantize(codes: Column | str, scale: Column | str, zero_point: Column | float = 0) -> Column:
    z = zero_point if isinstance(zero_point, Column) else F.lit(zero_point)
    return F.transform(_col(codes).cast("array<double>"), lambda c: (c - z) * _col(scale).cast("double"))


def vector_at(codes: Column | str, scale: Column | str) -> Column:
    """The unit vector that stored codes stand for; zero codes stay zero."""
    return normalize(dequantize(codes, scale))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def code_dot(a: Column | str, b: Column | str) -> Column:
    """Exact integer dot product of two code arrays."""
    both = F.zip_with(_col(a).cast("array<int>"), _col(b).cast("array<int>"), lambda x, y: x * y)
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def memory_bytes(count: Column, dim: Column, int8: bool) -> Column:
    return count * dim + 4 * count if int8 else 4 * count * dim


def windows(text: Column | str, size: int = 1300, overlap: int = 120) -> Column:
    """Overlapping windows; the last one ends with the text."""
    step = max(64, size - overlap)
    t = _col(text)
    n = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(t, i * step + 1, F.lit(size)))
