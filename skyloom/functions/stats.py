"""Densities, polynomials and bins as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def without_nan(df: DataFrame) -> DataFrame:
    """df as read: NaN and infinities of all floating columns, and of those in arrays, are null."""
    rule = {"double": finite, "float": finite, "array<double>": lambda c: F.transform(c, finite), "array<float>": lambda c: F.transform(c, finite)}
    return df.select(*(rule[t](F.col(f"`{c}`")).alias(c) if t in rule else F.col(f"`{c}`") for c, t in df.dtypes))


def normal_logpdf(x: Column, mu, sigma) -> Column:
    mu, sigma = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mu, sigma))
    return -0.5 * F.pow((x - mu) / sigma, 2) - F.log(sigma) - 0.5 * math.log(2 * math.pi)


def lognormal_logpdf(x: Column, mu: float, sigma: float) -> Column:
    return normal_logpdf(F.log(x), mu, sigma) - F.log(x)


def gamma_logpdf(x: Column, shape: float, rate: float) -> Column:
    return (shape - 1) * F.log(x) - rate * x + (shape * math.log(rate) - math.lgamma(shape))


def posterior(log_core: Column, log_tail: Column, share: float) -> Column:
    """share * core / (share * core + (1 - share) * tail), 0.5 where undefined."""
    odds = F.exp(log_tail - log_core) * ((1 - share) / share)
    return F.coalesce(finite(1 / (1 + odds)), F.lit(0.5))


def relative_error(err: Column, value: Column) -> Column:
    return F.abs(F.try_divide(err, value))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Highest power first, by Horner's rule."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def polynomial_error(x: Column, covariance: list[list[float]] | None, most: float = 5.0) -> Column:
    """sqrt(g C g) with g the powers of x; null beyond `most`, 0 without a covariance."""
    if covariance is None:
        return F.lit(0.0)
    n = len(covariance)
    g = [F.pow(x, n - 1 - i) for i in range(n)]
    v = sum((g[i] * g[j] * float(covariance[i][j]) for i in range(n) for j in range(n)), F.lit(0.0))
    e = F.sqrt(F.when(v > 0, v).otherwise(0 * v))
    return F.when(e <= most, e)


def combined_error(a: Column, b: Column, floor: float = 0.01) -> Column:
    e = F.sqrt(a * a + b * b)
    return F.when(e > floor, e).when(e.isNotNull(), F.lit(floor))


def bin_half_open(x: Column, low: float, high: float, n: int) -> Column:
    """Bins [lo, hi) numbered from 0; null outside."""
    k = F.floor((x - low) / ((high - low) / n))
    return F.when((x >= low) & (x < high), k)


def bin_last_closed(x: Column, low: float, high: float, n: int) -> Column:
    """Histogram bins: half-open, the last one closed."""
    k = F.least(F.floor((x - low) / ((high - low) / n)), F.lit(n - 1))
    return F.when((x >= low) & (x <= high), k)


def bin_open_low(x: Column, low: float, high: float, n: int) -> Column:
    """Bins (lo, hi], those beyond the ends held to the first and last."""
    return F.least(F.greatest(F.ceil((x - low) / ((high - low) / n)) - 1, F.lit(0)), F.lit(n - 1))


def plummer_density(r: Column, half_light: float, limit: float, axis_ratio: float = 1.0) -> Column:
    a2 = half_light**2 / (2 ** (2 / 3) - 1)
    norm = (a2 + limit**2) / (math.pi * a2 * limit**2 * axis_ratio)
    return F.when(r <= limit, norm / F.pow(1 + r * r / a2, 2)).otherwise(0.0)


def uniform_density(limit: float, axis_ratio: float = 1.0) -> Column:
    return F.lit(1 / (math.pi * limit**2 * axis_ratio))


def motion_covariance(e_ra: Column, e_dec: Column, rho: Column) -> tuple[Column, Column, Column]:
    """(xx, xy, yy) of a star's proper-motion errors; unknown correlation counts as none."""
    return e_ra * e_ra, F.coalesce(rho, F.lit(0.0)) * e_ra * e_dec, e_dec * e_dec


def binormal_logpdf(dx: Column, dy: Column, xx: Column, xy: Column, yy: Column, floor: float = 1e-6) -> Column:
    xx, yy = xx + floor, yy + floor
    det = xx * yy - xy * xy
    return -0.5 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det - 0.5 * F.log(det) - math.log(2 * math.pi)


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether (x, y) is in a polygon, by the number of edges that a ray to the right crosses; a box about it is looked at first. An edge
    holds its lower end and not its upper one, so of points on the border those on left and lower edges are inside, those on right and
    upper edges are not. Null where x or y is."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(vertices, [*vertices[1:], vertices[0]]):
        if ay != by:
            crossed = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (y - ay) * (bx - ax) / (by - ay) + ax)
            odd = odd != crossed
    xs, ys = zip(*vertices)
    return (x >= min(xs)) & (x <= max(xs)) & (y >= min(ys)) & (y <= max(ys)) & odd


# Outlines of stellar populations in colour and absolute magnitude.
POPULATIONS = {
    "Main Sequence": [(-0.2, 15.5), (0.0, 13.0), (0.3, 10.0), (0.6, 8.0), (1.0, 6.5), (1.5, 5.0), (2.0, 4.0), (2.5, 3.5), (3.0, 3.3), (3.5, 3.2), (4.0, 3.2), (4.0, 16.0), (-0.2, 16.0)],
    "RGB": [(0.8, 2.5), (1.0, 1.5), (1.2, 0.5), (1.4, -0.5), (1.6, -1.5), (1.9, -2.5), (2.2, -3.0), (2.5, -2.5), (2.7, -1.5), (2.5, -0.5), (2.2, 0.5), (1.8, 1.5), (1.4, 2.5)],
    "AGB": [(2.0, -1.0), (2.5, -1.5), (3.0, -1.3), (3.5, -0.8), (4.0, 0.0), (4.3, 0.8), (4.0, 1.5), (3.5, 1.2), (3.0, 0.5), (2.5, 0.0)],
    "White Dwarfs": [(-0.6, 9.0), (0.8, 9.0), (0.8, 16.0), (-0.6, 16.0)],
    "MS Turnoff": [(0.2, 2.0), (0.9, 2.0), (1.1, 4.5), (0.6, 4.5)],
    "Subgiants": [(0.8, 2.5), (1.8, 2.5), (2.0, 5.0), (1.2, 5.0)],
    "RGB Bump": [(0.9, 0.2), (1.5, 0.2), (1.5, 1.8), (0.9, 1.8)],
    "Red Clump": [(0.5, -0.5), (1.3, -0.5), (1.3, 1.5), (0.5, 1.5)],
    "TRGB": [(1.0, -5.5), (3.0, -5.5), (3.0, -3.5), (1.0, -3.5)],
    "Blue HB": [(-0.5, -1.5), (0.4, -1.5), (0.4, 2.0), (-0.5, 2.0)],
    "EHB/sdO": [(-0.6, 2.0), (0.0, 2.0), (0.0, 7.0), (-0.6, 7.0)],
}


def populations(x: Column, y: Column, outlines: dict[str, list[tuple[float, float]]] = POPULATIONS) -> Column:
    """Names of the outlines that hold (x, y), in their order."""
    return F.filter(F.array(*(F.when(in_polygon(x, y, v), F.lit(n)) for n, v in outlines.items())), lambda n: n.isNotNull())
