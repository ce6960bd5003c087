"""Fits of velocity scales and mixtures against plain loops over the same rows."""

import math

import numpy as np
import pandas as pd
import pytest

from skyloom.operators import mixture, velocity


def test_survey_calibration_is_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"survey": rng.choice(["LAMOST", "GALAH", "TINY"], n, p=[0.5, 0.45, 0.05]), "Teff": rng.uniform(4500, 7500, n), "logg": rng.uniform(1, 5, n), "FeH": np.where(rng.random(n) < 0.5, rng.normal(size=n), np.nan), "SNR": np.where(rng.random(n) < 0.1, 50.0, np.nan), "RV": rng.normal(0, 50, n), "err": rng.uniform(0.5, 3, n)})
    pdf["drv"] = 0.001 * pdf.Teff - 0.3 * pdf.logg + 0.2 * pdf.FeH.fillna(0) + 0.01 * pdf.RV + rng.normal(0, 0.1, n)
    got = velocity.survey_calibration(spark.createDataFrame(pdf.astype({"survey": str})), least=30)
    assert ("TINY", "all") not in got and {h for s, h in got if s == "LAMOST"} == {"cool", "hot"} and {h for s, h in got if s == "GALAH"} == {"dwarfs", "giants"}
    of = {"cool": pdf.Teff < 6200, "hot": pdf.Teff >= 6200, "dwarfs": pdf.logg > 3.5, "giants": pdf.logg <= 3.5}
    for (survey, half), beta in got.items():
        own = pdf[(pdf.survey == survey) & of[half]]
        assert list(beta) == ["Teff2", "Teff", "logg", "FeH", "RV", "intercept"]  # SNR is known to too few
        x = np.c_[own.Teff**2, own.Teff, own.logg, own.FeH.fillna(0), own.RV, np.ones(len(own))]
        w = 1 / own.err.to_numpy()
        want = x @ np.linalg.lstsq(x * w[:, None] / (scale := np.abs(x).max(axis=0)), own.drv * w, rcond=None)[0] * 0 + (x / scale) @ np.linalg.lstsq(x / scale * w[:, None], own.drv * w, rcond=None)[0]
        assert x @ np.array(list(beta.values())) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("degree, n", [(1, 900), (2, 6000), (2, 20_000)])
def test_binned_fit_is_that_of_its_bins(spark, degree, n):
    rng = np.random.default_rng(n)
    x = rng.uniform(0, 10, n)
    y = 0.3 * x * x - x + 5 + rng.normal(0, 1, n)
    fits = velocity.binned_fit(spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y})), ["k"], "x", "y", degree)
    bins = min(40, max(15, n // 300))
    lo, hi, zero = np.percentile(x, 1), np.percentile(x, 99), np.median(y)
    edges = np.linspace(lo, hi, bins + 1)
    rows = [((a + b) / 2, np.median(y[m] - zero), m.sum()) for a, b in zip(edges[:-1], edges[1:]) if (m := (x >= a) & (x < b)).sum() >= 10]
    bx, by, bw = np.array(rows).T
    want, cov = np.polyfit(bx, by, degree, w=np.sqrt(bw), cov=True)
    coefficients, got_cov, rows_of, got_zero = fits[("a",)]
    assert len(rows) == bins and rows_of == n and got_zero == pytest.approx(zero)
    assert coefficients == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9) and np.array(got_cov) == pytest.approx(cov, rel=1e-5, abs=1e-12)
    assert velocity.binned_fit(spark.createDataFrame(pd.DataFrame({"k": "a", "x": x[:40], "y": y[:40]})), ["k"], "x", "y", degree) == {}


def test_repeats_of_few_pairs_do_not_count(spark):
    rows = [("APOGEE", 2.0, 3.0, 4.0, 199), ("RAVE", 2.0, 3.0, 4.0, 200), ("GAIA", 2.0, 3.0, 4.0, 500), ("GES", 2.0, 3.0, 4.0, 500), ("GES2", 2.0, 30.0, 4.0, 500), ("SDSS", None, None, None, None)]
    got = {r.survey: r.factor for r in velocity.combined_factor(spark.createDataFrame(rows, "survey string, repeats double, triangles double, prior double, n_pairs long")).collect()}
    assert got == {"APOGEE": 4.0, "RAVE": 2.0, "GAIA": 3.0, "GES": 2.5, "GES2": 2.0, "SDSS": 1.0}


def loop_em(y, d2, start, share_range, floors, prior=(1.0, 1.0), order=None, rounds=500):
    """Log likelihood (with the prior), share, core, tail of a two-normal mixture whose rows have their own variances."""
    share, core, tail, before = *start, -math.inf
    for _ in range(rounds):
        a, b = (np.log(s) - 0.5 * ((y - m) ** 2 / (w * w + d2) + np.log(2 * np.pi * (w * w + d2))) for s, (m, w) in ((share, core), (1 - share, tail)))
        top = np.logaddexp(a, b)
        g = np.exp(a - top)
        if abs(top.sum() - before) <= 1e-10 * abs(top.sum()):
            break
        before = top.sum()
        share = np.clip((g.sum() + prior[0] - 1) / (len(y) + sum(prior) - 2), *share_range)
        parts = []
        for w, floor in ((g, floors[0]), (1 - g, floors[1])):
            m = (w * y).sum() / w.sum()
            parts.append((m, math.sqrt(max((w * ((y - m) ** 2 - d2)).sum() / w.sum(), floor**2))))
        core, tail, turned = order(*parts)
        share = np.clip(1 - share, *share_range) if turned else share
    return before + (prior[0] - 1) * math.log(share) + (prior[1] - 1) * math.log(1 - share), share, core, tail


def test_deconvolved_mixture_is_that_of_a_loop(spark):
    rng = np.random.default_rng(6)
    n = 2000
    e = rng.uniform(0.1, 1.0, n)
    x = np.r_[rng.normal(2, 0.5, 500), rng.normal(4, 2.5, 1500)] + rng.normal(0, 1, n) * e
    e[::50] = np.nan
    df = spark.createDataFrame([(float(a), None if math.isnan(b) else float(b)) for a, b in zip(x, e)], "x double, e double")
    got = mixture.fit_deconvolved(df, "x", "e", -10.0, 15.0, iterations=300, tolerance=1e-9)
    keep = (x > -10) & (x < 15)
    y, d2 = x[keep], np.where(np.isnan(e), 0.1 * np.abs(x), e)[keep] ** 2
    starts, spread = mixture._deconvolved_starts(y, np.ones(len(y)), 10)
    narrow = lambda a, b: (b, a, True) if b[1] < a[1] else (a, b, False)
    loglik, share, core, tail = max((loop_em(y, d2, s, (0.05, 0.95), (0.1 * spread,) * 2, order=narrow) for s in starts), key=lambda f: f[0])
    assert got.loglik == pytest.approx(loglik, rel=1e-6) and (got.share, *got.core, *got.tail) == pytest.approx((share, *core, *tail), rel=0.02)
    # a core of about a quarter of the rows, which a share of 0.4 at least could not tell
    assert got.share < 0.35 and mixture.fit_deconvolved(df.limit(20), "x", "e", 0, 9) is None


def test_lognormal_with_own_errors_is_that_of_a_loop(spark):
    rng = np.random.default_rng(8)
    n = 3000
    delta = rng.uniform(0.05, 0.6, n)
    y = np.where(rng.random(n) < 0.7, rng.normal(-2, 0.35, n), rng.normal(-0.5, 0.9, n)) + rng.normal(0, 1, n) * delta
    x = np.exp(y)
    keep = x < 10
    df = spark.createDataFrame([(float(a), float(a * d)) for a, d in zip(x, delta)] + [(0.5, None), (float("nan"), 0.1), (0.4, float("nan"))], "x double, e double")
    got = mixture.fit_lognormal(df, "x", error="e")
    y, d2 = np.r_[y[keep], math.log(0.5), math.log(0.4)], np.r_[delta[keep] ** 2, 0.01, 0.01]
    med = np.median(y)
    s = (med - np.quantile(y, 0.1)) / 1.28

    def order(core, tail):
        turned = tail[0] < core[0]
        core, tail = (tail, core) if turned else (core, tail)
        return core, (max(tail[0], core[0] + 0.5 * core[1]), max(tail[1], 1.2 * core[1])), turned

    starts = [(0.75, (med, s), (np.quantile(y, 0.9), 2 * s)), (0.6, (med, s), (med + 2 * s, 2.5 * s))]
    best = max((loop_em(y, d2, st, (0.5, 0.95), (0.1, 0.05**0.5), (5.0, 2.0), order) for st in starts), key=lambda f: f[0])
    assert (got.share, *got.core, *got.tail) == pytest.approx((best[1], *best[2], *best[3]), abs=0.02)
    assert got.core == pytest.approx((-2, 0.35), abs=0.1)  # without the errors the core looks half as wide again
    assert mixture.fit_lognormal(df, "x").core[1] > 1.2 * got.core[1]
