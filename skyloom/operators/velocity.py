"""Putting radial velocities of several surveys on one scale."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..storage import stored
from .binning import binned_median
from .keyed_join import top_per_group
from .quantiles import medians
from .robust import SCALE, inverse_variance, median_mad

# Which error factors a survey's own one is taken from, in order.
REPEATS_FIRST, TRIANGLES_ONLY, AVERAGED = ("APOGEE", "RAVE", "LAMOST"), ("GAIA", "GALAH"), ("GES",)
PLAUSIBLE = (0.1, 20.0)


def without_copies(df: DataFrame) -> DataFrame:
    """First row (row_id) of each survey, velocity and error, both rounded half-even to 6 digits; rows whose
    velocity and error agree in size (a filler value) go."""
    ok = df.filter("rv IS NOT NULL AND err > 0 AND abs(abs(rv) - abs(err)) >= 1e-6")
    return ok.groupBy("survey", F.bround("rv", 6).alias("_rv"), F.bround("err", 6).alias("_err")).agg(F.min_by(F.struct(*df.columns), "row_id").alias("r")).select("r.*")


def _differences(worst_ratio: float, most_pairs: int):
    """Rows (survey, star, err, rv) in order, a star's repeats together -> survey, t of their pairs. Comparisons are those of
    Spark, for which NaN is the largest number and equal to itself; what is null makes no pair."""

    def pairs(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        known = rows.column("err").is_valid().to_numpy(zero_copy_only=False) & rows.column("rv").is_valid().to_numpy(zero_copy_only=False)
        e, v = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("err", "rv"))
        size = np.diff(np.r_[first, len(e)])
        later = np.repeat(first + size, size) - np.arange(len(e)) - 1  # fellows after each row
        i = np.repeat(np.arange(len(e)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        with np.errstate(all="ignore"):
            d = v[i] - v[j]
            ok = known[i] & known[j] & ((e[j] <= e[i] * worst_ratio) | np.isnan(e[i])) & ~(np.abs(d) < 1e-6)
            i, j, d = i[ok], j[ok], d[ok]
            star = np.searchsorted(first, i, "right")
            kept = np.arange(len(star)) - np.searchsorted(star, star) < most_pairs
            t = d / np.sqrt(e[i] * e[i] + e[j] * e[j])
        return pa.RecordBatch.from_arrays([rows.column("survey").take(pa.array(i[kept])), pa.array(t[kept])], ["survey", "t"])

    def run(batches):
        held = None  # the last star's rows, which may go on in the next batch
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            code = [rows.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("survey", "star")]
            first = np.flatnonzero(np.r_[True, (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1])])
            if rows.num_rows:
                held = rows.slice(first[-1])
                if first[-1]:
                    yield pairs(rows.slice(0, first[-1]), first[:-1])
        if held is not None:
            yield pairs(held, np.array([0]))

    return run


def repeat_pairs(df: DataFrame, most_rows: int = 30, most_pairs: int = 200, worst_ratio: float = 5.0) -> DataFrame:
    """survey, t of the pairs of a star's repeats in a survey: its most_rows smallest errors, error ratio within worst_ratio and
    differing velocities; at most most_pairs a star, in order. t = difference over combined error. The best rows are
    ranked first, which Spark limits before the shuffle, so a star has most_rows rows at most; the pairs are made from them as they
    stand, in the ranking's own order, by arrays."""
    order = ["survey", "star", "err", "row_id"]
    ranked = top_per_group(df.select("survey", "star", F.col("err").cast("double").alias("err"), "row_id", F.col("rv").cast("double").alias("rv")), order[:2], order[2:], most_rows)
    rows = ranked.sortWithinPartitions(*order).select("survey", "star", "err", "rv")
    return rows.mapInArrow(_differences(worst_ratio, most_pairs), f"survey {dict(df.dtypes)['survey']}, t double")


def repeat_factor(pairs: DataFrame, clip: float = 50.0, again: float = 5.0, least: int = 50) -> DataFrame:
    """survey, n_pairs, factor: scaled MAD of t after a clip and one re-clip at `again` times it. Pairs are written once, and
    read by each pass."""
    t = stored(pairs.filter(F.abs("t") <= clip).select("survey", "t"), "pairs")
    one = stored(median_mad(t, ["survey"], "t", SCALE, keep=False), "spreads")
    inside = t.join(one, "survey").filter(F.abs(F.col("t") - F.col("median")) <= again * F.col("mad")).select("survey", "t")
    return median_mad(inside, ["survey"], "t", SCALE, keep=False).filter(F.col("n") >= least).select("survey", F.col("n").alias("n_pairs"), F.col("mad").alias("factor"))


def survey_means(df: DataFrame) -> DataFrame:
    """survey, star, rv, err: inverse-variance mean of a star in a survey."""
    m, e = inverse_variance(F.col("rv"), F.col("err"))
    return df.groupBy("survey", "star").agg(m.alias("rv"), e.alias("err")).filter("rv IS NOT NULL")


def zero_points(means: DataFrame, least: int = 30) -> DataFrame:
    """a, b, n, zero_point (median of rv_a - rv_b) and variance (scaled MAD squared) of survey pairs a < b with
    `least` shared stars; pairs with a variance under 1e-6 are skipped."""
    a = means.select(F.col("survey").alias("a"), "star", F.col("rv").alias("ra"))
    d = a.join(means.select(F.col("survey").alias("b"), "star", F.col("rv").alias("rb")), "star").filter("a < b").select("a", "b", (F.col("ra") - F.col("rb")).alias("d"))
    z = median_mad(d, ["a", "b"], "d", SCALE).filter(F.col("n") >= least)
    return z.select("a", "b", "n", F.col("median").alias("zero_point"), F.pow("mad", F.lit(2)).alias("variance")).filter("variance >= 1e-6")


def three_cornered(pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """Per survey s over triangles (s, x, y): (v_sx + v_sy - v_xy) / 2, weighted by the smallest n of its sides,
    positive ones only; factor = its root over the survey's median error. errors: survey, err."""
    both = pairs.select("a", "b", "n", "variance").union(pairs.select("b", "a", "n", "variance"))
    side = lambda x, y, k: both.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"n{k}"), F.col("variance").alias(f"v{k}"))
    tri = side("s", "x", 1).join(side("s", "y", 2), "s").filter("x < y").join(side("x", "y", 3), ["x", "y"])
    tri = tri.withColumns({"own": (F.col("v1") + F.col("v2") - F.col("v3")) / 2, "w": F.least("n1", "n2", "n3")}).filter("own > 0")
    var = tri.groupBy(F.col("s").alias("survey")).agg((F.sum(F.col("w") * F.col("own")) / F.sum("w")).alias("variance"), F.count(F.lit(1)).alias("n_triangles"))
    return var.join(medians(errors, ["survey"], "err", "_e").drop("n"), "survey").select("survey", "n_triangles", "variance", (F.sqrt("variance") / F.col("_e")).alias("factor"))


def combined_factor(df: DataFrame, repeats: str = "repeats", triangles: str = "triangles", prior: str = "prior", pairs: str = "n_pairs", least_pairs: int = 200) -> DataFrame:
    """factor per survey from up to three estimates, by the class of the survey; implausible ones do not count, nor do
    repeats of fewer than least_pairs pairs."""
    ok = lambda c: F.when((F.col(c) > PLAUSIBLE[0]) & (F.col(c) < PLAUSIBLE[1]), F.col(c))
    d, t, p, one = F.when(F.col(pairs) >= least_pairs, ok(repeats)), ok(triangles), ok(prior), F.lit(1.0)
    s = F.col("survey")
    return df.withColumn(
        "factor",
        F.when(s.isin(*REPEATS_FIRST), F.coalesce(d, p, t, one)).when(s.isin(*TRIANGLES_ONLY), F.coalesce(t, p, one)).when(s.isin(*AVERAGED), F.coalesce((d + t) / 2, d, t, p, one)).otherwise(F.coalesce(t, d, p, one)),
    )


def binned_fit(df: DataFrame, keys: list[str], x: str, y: str, degree: int, least: int = 50) -> dict[tuple, tuple[list[float], list[list[float]] | None, int, float]]:
    """Per group of `least` rows a polynomial through the medians of y, less the group's median, in rows / 300 bins (15 to 40),
    weighted by the root of the bins' counts: coefficients (highest power first), covariance, rows and the median
    taken off. Fewer than degree + 2 bins of ten rows make no fit; a covariance that is not finite is replaced by the
    unscaled one. At most 40 bins of each group come to the driver."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    zero = medians(known, keys, y, "_zero").withColumnRenamed("n", "_rows").filter(F.col("_rows") >= least)
    shifted = known.join(zero, keys).withColumn("_y", F.col(y) - F.col("_zero"))
    n_bins = F.least(F.greatest(F.floor(F.col("_n") / 300), F.lit(15)), F.lit(40))
    bins = binned_median(shifted.select(*keys, x, "_y"), keys, x, "_y", n_bins).join(zero, keys)
    rows = bins.select(*keys, "centre", "n", "median", "_zero", "_rows").orderBy(*keys, "centre").collect()
    out = {}
    for k in dict.fromkeys(tuple(r[c] for c in keys) for r in rows):
        own = [r for r in rows if tuple(r[c] for c in keys) == k]
        if len(own) < degree + 2:
            continue
        a, b, w = (np.array([r[c] for r in own], float) for c in ("centre", "median", "n"))
        coefficients, cov = np.polyfit(a, b, degree, w=np.sqrt(w), cov=True)
        if not np.isfinite(cov).all():
            coefficients, cov = np.polyfit(a, b, degree, w=np.sqrt(w), cov="unscaled")
        out[k] = (coefficients.tolist(), cov.tolist() if np.isfinite(cov).all() else None, own[0]["_rows"], own[0]["_zero"])
    return out


def pooled(fits: dict) -> tuple[list[float], list[list[float]] | None]:
    """Mean of several fits, weighted by their rows."""
    n = np.array([f[2] for f in fits.values()], float)
    coefficients = np.average([f[0] for f in fits.values()], axis=0, weights=n)
    covs = [(f[1], f[2]) for f in fits.values() if f[1] is not None]
    return coefficients.tolist(), np.average([c for c, _ in covs], axis=0, weights=[m for _, m in covs]).tolist() if covs else None


def normal_equations(df: DataFrame, features: list[str], target: str, error: str, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares with an intercept: one aggregation gives the (k + 1)^2 sums, the driver solves."""
    xs = [F.lit(1.0), *(F.coalesce(F.col(f), F.lit(fill)) for f in features)]
    w, y = 1 / (F.col(error) * F.col(error)), F.col(target)
    sums = [F.sum(w * a * b) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(w * a * y) for a in xs]
    known = df.withColumns({c: finite(F.col(c)) for c in [*features, target, error]}).filter(y.isNotNull() & (F.col(error) > 0))
    got = np.array(known.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first(), float)
    k = len(xs)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = got[: k * (k + 1) // 2]
    m = m + np.triu(m, 1).T
    return np.linalg.lstsq(m, got[k * (k + 1) // 2 :], rcond=None)[0], m


# What a survey's difference from the reference is fitted on, and where its stars are split.
CALIBRATION_FEATURES = {"Teff2": ("Teff", 2), "Teff": ("Teff", 1), "logg": ("logg", 1), "FeH": ("FeH", 1), "SNR": ("SNR", 1), "RV": ("RV", 1)}
SPLIT_BY_TEFF, TEFF_SPLIT, LOGG_SPLIT = ("LAMOST",), 6200.0, 3.5


def survey_calibration(df: DataFrame, target: str = "drv", error: str = "err", least: int = 50, filled: float = 0.3) -> dict[tuple[str, str], dict[str, float]]:
    """Weighted least squares of target on CALIBRATION_FEATURES and an intercept for each survey of `least` rows and
    each of its halves: cool and hot (by Teff) or dwarfs and giants (by logg) where a half has more than `least` rows, all rows where
    none has. A feature counts where more than `filled` of the half's rows know it, unknown values as 0.
    One aggregation by (survey, half) gives the sums of all features; the driver solves one small system for each."""
    one = lambda c: finite(F.col(c))
    known = df.withColumn(target, one(target)).filter(F.col(target).isNotNull() & F.col("survey").isNotNull())
    by_teff = F.col("survey").isin(*SPLIT_BY_TEFF)
    half = F.when(by_teff, F.when(one("Teff") < TEFF_SPLIT, "cool").when(one("Teff") >= TEFF_SPLIT, "hot")).otherwise(F.when(one("logg") > LOGG_SPLIT, "dwarfs").when(one("logg") <= LOGG_SPLIT, "giants"))
    sure = F.greatest(F.coalesce(one(error), F.lit(1.0)), F.lit(0.01))
    w, y = 1 / (sure * sure), F.col(target)
    xs = [*(F.coalesce(F.pow(one(c), k), F.lit(0.0)) for c, k in CALIBRATION_FEATURES.values()), F.lit(1.0)]
    sums = [F.sum(w * a * b) for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(w * a * y) for a in xs] + [F.count(one(c)) for c, _ in CALIBRATION_FEATURES.values()] + [F.count(F.lit(1))]
    got = known.withColumn("half", half).groupBy("survey", "half").agg(*(s.cast("double").alias(f"c{i}") for i, s in enumerate(sums))).collect()
    of = {(r.survey, r.half): np.array(r[2:], float) for r in got}
    out, k = {}, len(xs)
    for survey in sorted({s for s, _ in of}):
        everything = sum(v for (s, _), v in of.items() if s == survey)
        halves = {h: v for (s, h), v in of.items() if s == survey and h is not None and v[-1] > least} or {"all": everything}
        for name, v in sorted(halves.items()) if everything[-1] >= least else ():
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = v[: k * (k + 1) // 2]
            m = m + np.triu(m, 1).T
            right, counts = v[k * (k + 1) // 2 : k * (k + 1) // 2 + k], v[-k:-1]
            use = np.r_[np.flatnonzero(counts > filled * v[-1]), k - 1]
            scale = np.sqrt(np.maximum(np.diag(m)[use], 1e-300))  # columns of very unlike size
            beta = np.linalg.lstsq(m[np.ix_(use, use)] / np.outer(scale, scale), right[use] / scale, rcond=None)[0] / scale
            out[survey, name] = {[*CALIBRATION_FEATURES, "intercept"][i]: float(b) for i, b in zip(use, beta)}
    return out


def calibrated(df: DataFrame, fits: dict, key: str, x: str, rv: str = "rv", err: str = "err") -> DataFrame:
    """rv less the group's polynomial in x, the fit's error added to err; groups without a fit, and rows whose fit
    is too uncertain, keep theirs and are marked."""
    shift, extra = F.lit(None).cast("double"), F.lit(None).cast("double")
    from ..functions.stats import polynomial, polynomial_error

    for k, (coefficients, cov, *_) in fits.items():
        own = F.col(key) == F.lit(k[0])
        shift = F.when(own, polynomial(F.col(x), coefficients)).otherwise(shift)
        extra = F.when(own, polynomial_error(F.col(x), cov)).otherwise(extra)
    out = df.withColumns({"_shift": shift, "_extra": extra})
    ok = F.col("_shift").isNotNull() & F.col("_extra").isNotNull()
    return out.withColumns(
        {"rv_cal": F.when(ok, F.col(rv) - F.col("_shift")).otherwise(F.col(rv)), "err_cal": F.when(ok, F.sqrt(F.col(err) * F.col(err) + F.col("_extra") * F.col("_extra"))).otherwise(F.col(err)), "is_calibrated": ok}
    ).drop("_shift", "_extra")


def normalised_errors(df: DataFrame, factors: DataFrame) -> DataFrame:
    """err times the survey's factor, 1 where it has none."""
    return df.join(factors.select("survey", F.col("factor").alias("_f")), "survey", "left").withColumn("err_norm", F.col("err") * F.coalesce("_f", F.lit(1.0))).drop("_f")


def without_surveys(df: DataFrame, excluded: list[str]) -> DataFrame:
    return df.filter(~F.col("survey").isin(*excluded))
