"""Small numeric expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(c(x).cast("double"), digits)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sigmoid(z: Column | str, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(c(z) / t)))


def smooth_label(y: Column | str, eps: float = 0.05) -> Column:
    return c(y) * (1.0 - eps) + 0.5 * eps


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(c(a), F.lit(0.0), lambda acc, v: acc + v * v))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def feature_ok(arr: Column | str) -> Column:
    """Every value finite and at least one non-zero."""
    a = c(arr)
    return F.coalesce(F.forall(a, is_finite) & F.exists(a, lambda x: x != 0.0), F.lit(False))


def edges(n: int) -> list[float]:
    """n + 1 equally spaced edges on [0, 1]; i / n is the correctly rounded value."""
    return [i / n for i in range(n + 1)]


def right_closed_bin(x: Column, n: int) -> Column:
    """Index b with edges[b] < x <= edges[b + 1]; NULL for x <= 0."""
    hits = [(x > F.lit(e)).cast("int") for e in edges(n)[1:-1]]
    return F.when(x > 0, reduce(lambda a, b: a + b, hits))


def equal_bin(x: Column, n: int) -> Column:
    """Left-closed equal bins on [0, 1]; the last bin also holds 1.0."""
    return F.when((x >= 0) & (x <= 1), F.least(F.floor(x * n), F.lit(n - 1)).cast("int"))
