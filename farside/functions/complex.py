"""Complex numbers as pairs of double columns (real, imaginary)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def turn(angle: Column) -> Pair:
    """exp(i * angle)."""
    return F.cos(angle), F.sin(angle)


def cexp(a: Pair) -> Pair:
    """exp of a complex number."""
    size, (c, s) = F.exp(a[0]), turn(a[1])
    return size * c, size * s


def cmul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def cabs(a: Pair) -> Column:
    return F.hypot(a[0], a[1])


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 (also under ANSI rules)."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)
