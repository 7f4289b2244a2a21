"""Column builders: distances, kernels, warping, distributions, encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 3.0) -> Column:
    if metric == "euclidean":
        return F.sqrt(euclidean2(a, b))
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "minkowski":
        return F.pow(_sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))
    if metric == "cosine":
        return angular(a, b)
    raise ValueError(f"unknown metric: {metric}")


def angular(a: Column, b: Column, tol: float = 1e-8) -> Column:
    """Angle between vectors over pi; a cosine within tol of 1 counts as 1."""
    c = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    c = F.when(c > 1 - tol, 1.0).otherwise(F.greatest(F.lit(-1.0), F.coalesce(c, F.lit(0.0))))
    return F.acos(c) / math.pi


def rbf(a: Column, b: Column, width: float) -> Column:
    return F.exp(-euclidean2(a, b) / width)


def affinity(d: Column, alpha: float = 0.5) -> Column:
    return F.exp(-alpha * d)


def squash(x: Column, p: Column | float) -> Column:
    """2 to the minus (x / p) squared: 1 at 0, a half at p."""
    return F.pow(F.lit(2.0), -F.pow(x / p, F.lit(2.0)))


def dtw(a: Column, b: Column, band: int | None = None) -> Column:
    """Warped distance: squared local costs, root of the sum; band bounds |i - j|."""
    inf = F.lit(float("inf"))
    m = F.size(b)
    start = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: inf))
    rows = F.zip_with(a, F.sequence(F.lit(1), F.size(a)), lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def row(prev, r):
        def cell(acc, j):
            best = F.least(F.element_at(acc, -1), F.element_at(prev, j), F.element_at(prev, j + 1))
            d = r["x"] - F.element_at(b, j)
            cost = d * d + best
            return F.concat(acc, F.array(cost if band is None else F.when(F.abs(r["i"] - j) <= band, cost).otherwise(inf)))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(inf), cell)

    return F.sqrt(F.element_at(F.aggregate(rows, start, row), -1))


def sliding_nearest(seg: Column, shape: Column) -> Column:
    """Least Euclidean distance of shape to any window of seg of its length."""
    starts = F.sequence(F.lit(1), F.size(seg) - F.size(shape) + 1)
    return F.sqrt(F.array_min(F.transform(starts, lambda i: euclidean2(F.slice(seg, i, F.size(shape)), shape))))


def exponweib_cdf(t: Column, a: float | Column, c: float | Column, loc: float | Column = 0.0, scale: float | Column = 1.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    x = (t - lit(loc)) / lit(scale)
    return F.when(x > 0, F.pow(1 - F.exp(-F.pow(x, lit(c))), lit(a))).otherwise(0.0)


def exponweib_logpdf(t: Column, a: float, c: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    x = (t - loc) / scale
    inside = math.log(a) + math.log(c) - math.log(scale) + (a - 1) * F.log(-F.expm1(-F.pow(x, F.lit(float(c))))) - F.pow(x, F.lit(float(c))) + (c - 1) * F.log(x)
    return F.when(x > 0, inside)


def hour_code(ts: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.hour(ts) / 24
    return F.sin(angle), F.cos(angle)


def finite(x: Column, big: float = 1.7976931348623157e308) -> Column:
    """NaN and null as 0, infinities as the largest finite numbers."""
    x = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.when(x == float("inf"), big).when(x == float("-inf"), -big).otherwise(x)
