"""Column expressions for vectors that are kept as three scalar columns, so that plans prune and compile them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """Columns prefix+x+suffix, prefix+y+suffix and prefix+z+suffix."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Vec, b: Vec, t: Column) -> Vec:
    return tuple(p + (q - p) * t for p, q in zip(a, b, strict=True))


def ratio(a, b: Column) -> Column:
    """a / b, null where b is zero (division by zero is an error under ANSI rules)."""
    return F.try_divide(a, b)


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def safe_acos(v: Column) -> Column:
    return F.acos(clamp(v, -1.0, 1.0))


def angle(a: Vec, b: Vec) -> Column:
    """Angle between two vectors, stable for small and flat angles."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def minimum_image(delta: Column, length: float, periodic: bool = True) -> Column:
    """A difference taken to its nearest periodic image; halves round away from zero."""
    return delta - F.lit(length) * F.round(delta / F.lit(length)) if periodic else delta


def wrap(v: Column, low: float, length: float) -> Column:
    return v - F.lit(length) * F.floor((v - F.lit(low)) / F.lit(length))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the optimizer moves the result into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
