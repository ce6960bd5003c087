"""Two-component mixtures fitted by expectation-maximisation.

Data are first counted in narrow bins (of the logarithm for positive data), at most n_bins rows however
large the table; each iteration then runs over the bins. The bins are far narrower than any component's
floor, so the fit is that of the rows within the bins' width.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite, gamma_logpdf, lognormal_logpdf, normal_logpdf, posterior
from ..storage import discard, stored


@dataclass
class Mixture:
    kind: str
    share: float
    core: tuple[float, float]
    tail: tuple[float, float]
    loglik: float
    n_iter: int

    def purity(self, x: Column) -> Column:
        """Posterior of the core; 0.5 where x is unknown or outside the model's domain."""
        pdf = {"lognormal": lognormal_logpdf, "gamma": gamma_logpdf, "normal": normal_logpdf}[self.kind]
        p = posterior(pdf(x, *self.core), pdf(x, *self.tail), self.share)
        known = x.isNotNull() & ~F.isnan(x)
        return F.when(known & (x > 0) if self.kind != "normal" else known, p).otherwise(0.5)


def binned(df: DataFrame, value: str, low: float, high: float, log: bool, n_bins: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and count of each bin of low < value < high."""
    v = F.col(value)
    rows = df.filter((v > low) & (v < high)).select(v.alias("x"), (F.log(v) if log else v).alias("y"))
    span = rows.agg(F.min("y"), F.max("y")).first()
    if span[0] is None:
        return np.zeros(0), np.zeros(0)
    width = max((span[1] - span[0]) / n_bins, 1e-12)
    got = rows.groupBy(F.floor((F.col("y") - span[0]) / width)).agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("y").collect()
    return np.array([r.y for r in got]), np.array([r.n for r in got], float)


def binned_with_errors(df: DataFrame, value: str, error: str, low: float, high: float, log: bool, n_bins: int = 4096, n_errors: int = 32, error_range: tuple[float, float] | None = (0.01, 2.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean value, count and mean squared error of each cell of low < value < high: n_bins bins of the value (of its logarithm, with the
    error as a share of the value) by n_errors of the error's logarithm. Without a positive error a row counts as one of a tenth of its value."""
    v = F.col(value)
    e = F.when(finite(F.col(error)) > 0, finite(F.col(error)))
    d = F.coalesce(e / F.abs(v), F.lit(0.1)) if log else F.coalesce(e, 0.1 * F.abs(v))
    d = d if error_range is None else F.least(F.greatest(d, F.lit(error_range[0])), F.lit(error_range[1]))
    rows = df.filter((v > low) & (v < high)).select((F.log(v) if log else v).alias("y"), F.greatest(d, F.lit(1e-12)).alias("d"))
    span = rows.agg(F.min("y"), F.max("y"), F.min(F.log("d")), F.max(F.log("d"))).first()
    if span[0] is None:
        return (np.zeros(0),) * 3
    width, step = max((span[1] - span[0]) / n_bins, 1e-12), max((span[3] - span[2]) / n_errors, 1e-12)
    got = rows.groupBy(F.floor((F.col("y") - span[0]) / width), F.floor((F.log("d") - span[2]) / step)).agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"), F.avg(F.col("d") * F.col("d")).alias("d2")).orderBy("y", "d2").collect()
    return tuple(np.array([r[c] for r in got], float) for c in ("y", "n", "d2"))


def _em(y, n, start, m_step, logpdf, share_range, iterations, tolerance, prior=None):
    share, core, tail = start
    total, before = n.sum(), -math.inf
    for it in range(1, iterations + 1):
        a, b = math.log(share) + logpdf(y, *core), math.log(1 - share) + logpdf(y, *tail)
        top = np.logaddexp(a, b)
        loglik = float((n * top).sum())
        g = np.exp(a - top)
        if abs(loglik - before) <= tolerance * abs(loglik):
            break
        before = loglik
        wc, wt = n * g, n * (1 - g)
        alpha, beta = prior or (1.0, 1.0)
        share = float(np.clip((wc.sum() + alpha - 1) / (total + alpha + beta - 2), *share_range))
        core, tail, swapped = m_step(y, wc, wt)
        if swapped:
            share = float(np.clip(1 - share, *share_range))
    return share, core, tail, loglik, it


def _weighted(y, w, floor, d2=0.0):
    """Mean and deviation, of which d2, the mean squared error of each bin, is taken off."""
    s = max(w.sum(), 1e-12)
    mu = float((w * y).sum() / s)
    return mu, math.sqrt(max(float((w * ((y - mu) ** 2 - d2)).sum() / s), floor * floor))


def fit_lognormal(df: DataFrame, value: str, low: float = 0.0, high: float = 10.0, share_range=(0.5, 0.95), separation: float | None = None, iterations: int = 500, tolerance: float = 1e-8, error: str | None = None) -> Mixture | None:
    """Core and tail of a positive quantity; a Beta(5, 2) prior holds the share. Without `separation` the tail's mean
    stays half a core deviation above the core's; with it the means stay `separation` robust
    deviations apart and the tail is at least twice as wide. error: a column of the rows' own errors, by which each bin of value and error is
    widened; the deviations are then those without them. None for fewer than 100 values."""
    y, n, d2 = binned_with_errors(df, value, error, low, high, True) if error else (*binned(df, value, low, high, True), 0.0)
    if n.sum() < 100:
        return None
    logpdf = lambda y, m, s: -0.5 * ((y - m) ** 2 / (s * s + d2) + np.log(s * s + d2)) - 0.5 * math.log(2 * math.pi) - y
    at = lambda p: float(np.interp(p * n.sum(), np.cumsum(n), y))
    med = at(0.5)
    order = np.argsort(np.abs(y - med))
    robust = max(1.4826 * float(np.interp(0.5 * n.sum(), np.cumsum(n[order]), np.abs(y - med)[order])), 1e-3)
    floor = 0.1 if separation is None else max(0.15, 0.1 * robust)

    def m_step(y, wc, wt):
        core, tail = _weighted(y, wc, floor, d2), _weighted(y, wt, max(floor, 0.05**0.5), d2)
        swapped = tail[0] < core[0]
        if swapped:
            core, tail = tail, core
        gap = 0.5 * core[1] if separation is None else separation * robust
        wide = 1.2 if separation is None else 2.0
        return core, (max(tail[0], core[0] + gap), max(tail[1], wide * core[1])), swapped

    starts = [(0.75, (med, max((med - at(0.1)) / 1.28, floor)), (at(0.9), 2 * max((med - at(0.1)) / 1.28, floor))), (0.7, (at(0.35), robust), (at(0.9), 2 * robust)), (0.6, (med, robust), (med + 2 * robust, 2.5 * robust))]
    rng = np.random.default_rng(42)  # the same further starts on every run
    for _ in range(7):
        mu, s = med + 0.3 * robust * rng.normal(), max(robust * rng.uniform(0.15, 0.5), floor)
        starts.append((rng.uniform(share_range[0] + 0.05, share_range[1] - 0.05), (mu, s), (mu + robust * rng.uniform(0.8, 2), s * rng.uniform(2, 4))))
    prior = (5.0, 2.0)
    fits = [_em(y, n, s, m_step, logpdf, share_range, iterations, tolerance, prior) for s in starts]
    score = lambda f: f[3] + (prior[0] - 1) * math.log(f[0]) + (prior[1] - 1) * math.log(1 - f[0])
    return Mixture("lognormal", *max(fits, key=score))


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))


def gamma_shape(mean: float, mean_log: float, newton: int = 3) -> float:
    s = max(math.log(mean) - mean_log, 1e-9)
    a = min(max((3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s), 0.5), 200.0)
    for _ in range(newton):
        a -= (math.log(a) - digamma(a) - s) / (1 / a - trigamma(a))
        a = min(max(a, 0.1), 500.0)
    return a


def fit_gamma(df: DataFrame, value: str, low: float = 0.0, high: float = 10.0, share_range=(0.4, 0.9), newton: int = 3, iterations: int = 300, tolerance: float = 1e-8) -> Mixture | None:
    """Core and tail gamma densities (shape, rate), ordered by mean. newton=0 keeps the closed-form shape."""
    log_x, n = binned(df, value, low, high, True)
    if n.sum() < 100:
        return None
    x = np.exp(log_x)
    logpdf = lambda x, a, b: (a - 1) * np.log(x) - b * x + a * math.log(b) - math.lgamma(a)

    def one(w):
        s = max(w.sum(), 1e-12)
        mean = float((w * x).sum() / s)
        a = gamma_shape(mean, float((w * log_x).sum() / s), newton)
        return a, a / mean

    def m_step(_, wc, wt):
        core, tail = one(wc), one(wt)
        swapped = tail[0] / tail[1] < core[0] / core[1]
        return (tail, core, True) if swapped else (core, tail, False)

    half = np.cumsum(n) <= 0.7 * n.sum()
    return Mixture("gamma", *_em(x, n, (0.7, one(n * half), one(n * ~half)), m_step, logpdf, share_range, iterations, tolerance))


def fit_normal(df: DataFrame, value: str, low: float = 0.0, high: float = 100.0, share_range=(0.4, 0.95), iterations: int = 300, tolerance: float = 1e-8) -> Mixture | None:
    """Narrow core and wide tail (at least half again as wide)."""
    y, n = binned(df, value, low, high, False)
    if n.sum() < 100:
        return None
    mu, s = _weighted(y, n, 1e-3)
    logpdf = lambda y, m, s: -0.5 * ((y - m) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)

    def m_step(y, wc, wt):
        core, tail = _weighted(y, wc, 0.01 * s), _weighted(y, wt, 0.01 * s)
        swapped = tail[1] < core[1]
        if swapped:
            core, tail = tail, core
        return core, (tail[0], max(tail[1], 1.5 * core[1])), swapped

    return Mixture("normal", *_em(y, n, (0.7, (mu, 0.5 * s), (mu, 2 * s)), m_step, logpdf, share_range, iterations, tolerance))


def _deconvolved_starts(y, n, n_starts):
    """Shares, means and deviations to begin with, from the median and its spread."""
    order = np.argsort(y)
    at = lambda v, k, p: float(np.interp(p * k.sum(), np.cumsum(k), v))
    med = at(y[order], n[order], 0.5)
    off = np.abs(y - med)
    by_off = np.argsort(off)
    s = max(1.4826 * at(off[by_off], n[by_off], 0.5), 1e-6)
    rng = np.random.default_rng(42)  # the same on every run
    starts = [(0.75, (med, 0.5 * s), (med + 2 * s, 2 * s))]
    for _ in range(n_starts - 1):
        starts.append((rng.uniform(0.6, 0.85), (med + 0.2 * s * rng.normal(), s * math.sqrt(rng.uniform(0.1, 0.5))), (med + s * rng.uniform(1, 3), s * math.sqrt(rng.uniform(1, 5)))))
    return starts, s


def fit_deconvolved(df: DataFrame, value: str, error: str, low: float, high: float, iterations: int = 60, tolerance: float = 1e-7, n_starts: int = 10, share_range=(0.05, 0.95)) -> Mixture | None:
    """Normal mixture whose rows have their own errors (a tenth of the value where unknown), the core the narrower part. n_starts beginnings are
    followed over a table of value and error cells; from where the likeliest one ends, each iteration is one aggregation of
    the responsibilities' sums over all rows."""
    y, n, d2 = binned_with_errors(df, value, error, low, high, False, error_range=None)
    if n.sum() < 100 or not np.ptp(y):
        return None
    starts, spread = _deconvolved_starts(y, n, n_starts)
    floor = 0.1 * spread
    logpdf = lambda y, m, s: -0.5 * ((y - m) ** 2 / (s * s + d2) + np.log(s * s + d2)) - 0.5 * math.log(2 * math.pi)

    def m_step(y, wc, wt):
        core, tail = _weighted(y, wc, floor, d2), _weighted(y, wt, floor, d2)
        return (tail, core, True) if tail[1] < core[1] else (core, tail, False)

    share, core, tail, *_ = max((_em(y, n, s, m_step, logpdf, share_range, 500, tolerance) for s in starts), key=lambda f: f[3])
    v = F.col(value)
    # stored: what df comes of is worked out once, not once an iteration
    rows = stored(df.filter((v > low) & (v < high)).select(v.alias("x"), F.coalesce(F.when(finite(F.col(error)) > 0, F.col(error)), 0.1 * F.abs(v)).alias("e")), "values")
    total, before = float(n.sum()), -math.inf
    for it in range(1, iterations + 1):
        wide = lambda s: F.sqrt(F.lit(s * s) + F.col("e") * F.col("e"))
        a = math.log(share) + normal_logpdf(F.col("x"), core[0], wide(core[1]))
        b = math.log(1 - share) + normal_logpdf(F.col("x"), tail[0], wide(tail[1]))
        g = 1 / (1 + F.exp(F.least(b - a, F.lit(700.0))))
        both = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
        r = rows.select("x", "e", g.alias("g"), both.alias("l")).agg(
            F.sum("l").alias("l"), *(F.sum(w * t).alias(f"{n}{k}") for n, w in (("c", F.col("g")), ("t", 1 - F.col("g"))) for k, t in enumerate((F.lit(1.0), F.col("x"), F.col("x") * F.col("x"), F.col("e") * F.col("e"))))
        ).first()
        if abs(r.l - before) <= tolerance * abs(r.l):
            break
        before = r.l
        share = min(max(r.c0 / total, share_range[0]), share_range[1])
        one = lambda s0, s1, s2, s3: (s1 / max(s0, 1e-12), math.sqrt(max((s2 - s3) / max(s0, 1e-12) - (s1 / max(s0, 1e-12)) ** 2, floor * floor)))
        core, tail = one(r.c0, r.c1, r.c2, r.c3), one(r.t0, r.t1, r.t2, r.t3)
        if tail[1] < core[1]:
            core, tail, share = tail, core, 1 - share
    discard(rows)
    return Mixture("normal", share, core, tail, r.l, it)


FITS = {"lognormal": fit_lognormal, "gamma": fit_gamma, "normal": fit_normal}


def compare(df: DataFrame, value: str, low: float, high: float, kinds=("lognormal", "gamma")) -> DataFrame:
    """Table of the fits: kind, share, core, tail, loglik, bic, n_iter."""
    n = df.filter((F.col(value) > low) & (F.col(value) < high)).count()
    rows = [(k, m.share, *m.core, *m.tail, m.loglik, 5 * math.log(n) - 2 * m.loglik, m.n_iter) for k in kinds if (m := FITS[k](df, value, low, high))]
    return df.sparkSession.createDataFrame(rows, "kind string, share double, core_1 double, core_2 double, tail_1 double, tail_2 double, loglik double, bic double, n_iter int")


def combined_purity(columns: list[str]) -> Column:
    """Product of purities; unknown ones count as 1."""
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(F.col(c), F.lit(1.0))
    return out
