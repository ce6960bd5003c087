"""Queries of velocity scales, mixtures and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import membership, mixture, quantiles, robust, velocity, whole_objects
from ..storage import stored
from .adapters import SQL_MEASURE, SQL_STAR, detections, measurements, prefixed, stars  # noqa: F401

QUERIES: dict = {}


def query(name, sql=None):
    return lambda f: QUERIES.setdefault(name, (f, sql)) and f


_PAIRS = """g AS (SELECT survey, star, list(struct_pack(err := err, row_id := row_id, rv := rv) ORDER BY err, row_id)[1:30] AS m FROM v GROUP BY 1, 2), e AS (SELECT survey, star, unnest(m) AS a, generate_subscripts(m, 1) AS i FROM g),
p AS (SELECT x.survey, x.star, x.i, y.i AS j, x.a AS a, y.a AS b FROM e x JOIN e y ON x.survey = y.survey AND x.star = y.star AND x.i < y.i WHERE y.a.err <= x.a.err * 5 AND abs(x.a.rv - y.a.rv) >= 1e-6),
k AS (SELECT *, row_number() OVER (PARTITION BY survey, star ORDER BY i, j) AS n FROM p), t AS (SELECT survey, (a.rv - b.rv) / sqrt(a.err * a.err + b.err * b.err) AS t FROM k WHERE n <= 200)"""
_VALID = "v AS (SELECT * FROM m WHERE rv IS NOT NULL AND err > 0)"


def _valid(spark, sf):
    return measurements(spark, sf).filter("rv IS NOT NULL AND err > 0")


_REPEATS = f"""{_PAIRS}, c AS (SELECT * FROM t WHERE abs(t) <= 50), m1 AS (SELECT survey, median(t) AS m FROM c GROUP BY survey), s1 AS (SELECT survey, max(m) AS m, 1.4826 * median(abs(t - m)) AS s FROM c JOIN m1 USING (survey) GROUP BY survey),
c2 AS (SELECT survey, t FROM c JOIN s1 USING (survey) WHERE abs(t - m) <= 5 * s), m2 AS (SELECT survey, median(t) AS m, count(*) AS n_pairs FROM c2 GROUP BY survey HAVING count(*) >= 50) SELECT survey, max(n_pairs) AS n_pairs, round(1.4826 * median(abs(t - m)), 5) AS factor FROM c2 JOIN m2 USING (survey) GROUP BY survey"""


@query(
    "M18_repeat_factor",
    f"WITH {SQL_MEASURE}, {_VALID}, {_REPEATS}",
)
def m18(spark, sf):
    return velocity.repeat_factor(velocity.repeat_pairs(_valid(spark, sf))).select("survey", "n_pairs", F.round("factor", 5).alias("factor"))


_MEANS = "mean AS (SELECT survey, star, sum(rv / (err * err)) / sum(1 / (err * err)) AS rv, 1 / sqrt(sum(1 / (err * err))) AS err FROM v GROUP BY 1, 2)"
_ZERO = "d AS (SELECT x.survey AS a, y.survey AS b, x.rv - y.rv AS d FROM mean x JOIN mean y ON x.star = y.star AND x.survey < y.survey), z AS (SELECT a, b, count(*) AS n, median(d) AS zp FROM d GROUP BY 1, 2 HAVING count(*) >= 30), var AS (SELECT a, b, max(n) AS n, max(zp) AS zero_point, pow(1.4826 * median(abs(d - zp)), 2) AS variance FROM d JOIN z USING (a, b) GROUP BY 1, 2)"


@query("M19_zero_points", f"WITH {SQL_MEASURE}, {_VALID}, {_MEANS}, {_ZERO} SELECT a, b, n, round(zero_point, 4) AS zero_point, round(variance, 2) AS variance FROM var WHERE variance >= 1e-6")
def m19(spark, sf):
    z = velocity.zero_points(velocity.survey_means(_valid(spark, sf)))
    return z.select("a", "b", "n", F.round("zero_point", 4).alias("zero_point"), F.round("variance", 2).alias("variance"))


_HAT = f"""{_MEANS}, {_ZERO}, w AS (SELECT a, b, n, variance FROM var WHERE variance >= 1e-6), bo AS (SELECT * FROM w UNION ALL SELECT b, a, n, variance FROM w),
tri AS (SELECT p.a AS survey, (p.variance + q.variance - r.variance) / 2 AS own, least(p.n, q.n, r.n) AS wt FROM bo p JOIN bo q ON p.a = q.a AND p.b < q.b JOIN bo r ON r.a = p.b AND r.b = q.b), g AS (SELECT survey, sum(wt * own) / sum(wt) AS variance, count(*) AS n_triangles FROM tri WHERE own > 0 GROUP BY survey), e AS (SELECT survey, median(err) AS e FROM mean GROUP BY survey)
SELECT survey, n_triangles, round(variance, 2) AS variance, round(sqrt(variance) / e, 4) AS factor FROM g JOIN e USING (survey)"""


@query(
    "M20_three_cornered_hat",
    f"WITH {SQL_MEASURE}, {_VALID}, {_HAT}",
)
def m20(spark, sf):
    means = stored(velocity.survey_means(_valid(spark, sf)), "means")
    return velocity.three_cornered(velocity.zero_points(means), means).select("survey", "n_triangles", F.round("variance", 2).alias("variance"), F.round("factor", 4).alias("factor"))


# the tables' four surveys under names of each class
_NAMES = {"AF": "APOGEE", "NF": "GES", "NO": "GAIA", "RF": "SDSS"}
_NAMED = "CASE survey " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE survey END"
_OK = lambda c: f"CASE WHEN {c} > 0.1 AND {c} < 20 THEN {c} END"


@query(
    "M21_combined_factors",
    f"""WITH {SQL_MEASURE}, raw AS (SELECT * FROM m WHERE rv IS NOT NULL AND err > 0), v AS (SELECT * REPLACE ({_NAMED} AS survey) FROM raw), rep AS (WITH {_REPEATS}), hat AS (WITH {_HAT}), pri AS (SELECT survey, median(snr / err) AS p FROM v GROUP BY survey),
f AS (SELECT survey, CASE WHEN n_pairs >= 200 THEN {_OK("rep.factor")} END AS d, {_OK("hat.factor")} AS t, {_OK("p")} AS p FROM pri LEFT JOIN rep USING (survey) LEFT JOIN hat USING (survey))
SELECT survey, round(CASE WHEN survey IN ('APOGEE', 'RAVE', 'LAMOST') THEN coalesce(d, p, t, 1) WHEN survey IN ('GAIA', 'GALAH') THEN coalesce(t, p, 1) WHEN survey = 'GES' THEN coalesce((d + t) / 2, d, t, p, 1) ELSE coalesce(t, d, p, 1) END, 3) AS factor FROM f""",
)
def m21(spark, sf):
    v = _valid(spark, sf).withColumn("survey", F.expr(_NAMED))
    repeats = velocity.repeat_factor(velocity.repeat_pairs(v)).select("survey", "n_pairs", F.col("factor").alias("repeats"))
    means = stored(velocity.survey_means(v), "means")
    hat = velocity.three_cornered(velocity.zero_points(means), means).select("survey", F.col("factor").alias("triangles"))
    prior = quantiles.medians(v.withColumn("ratio", F.col("snr") / F.col("err")), ["survey"], "ratio", "prior").drop("n")
    return velocity.combined_factor(prior.join(repeats, "survey", "left").join(hat, "survey", "left")).select("survey", F.round("factor", 3).alias("factor"))


SQL_FITS = """s AS (SELECT survey, quantile_cont(err, 0.01) AS lo, quantile_cont(err, 0.99) AS hi, count(*) AS n, median(rv) AS zero, least(40, greatest(15, count(*) // 300)) AS nb FROM v GROUP BY survey HAVING count(*) >= 50),
b AS (SELECT survey, least(floor((err - lo) / ((hi - lo) / nb)), nb - 1) AS bin, lo, (hi - lo) / nb AS width, rv - zero AS y FROM v JOIN s USING (survey) WHERE err >= lo AND err < hi),
g AS (SELECT survey, max(lo + (bin + 0.5) * width) AS x, count(*) AS w, median(y) AS y FROM b GROUP BY survey, bin HAVING count(*) >= 10),
q AS (SELECT survey, count(*) AS k, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM g GROUP BY survey HAVING count(*) >= 3),
line AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw AS intercept FROM q),
fit AS (SELECT survey, any_value(s.n) AS n, any_value(zero) AS zero, any_value(slope) AS slope, any_value(intercept) AS intercept, sum(w * pow(y - slope * x - intercept, 2)) / (any_value(k) - 2) / any_value(sw * sxx - sx * sx) AS f, any_value(sw) AS sw, any_value(sx) AS sx, any_value(sxx) AS sxx FROM g JOIN line USING (survey) JOIN s USING (survey) GROUP BY survey)"""


@query(
    "M22_binned_polynomials",
    f"WITH {SQL_MEASURE}, {_VALID}, {SQL_FITS} SELECT survey, round(slope, 4) AS slope, round(intercept, 3) AS intercept, n, round(zero, 4) AS zero FROM fit UNION ALL SELECT '(all)', round(sum(n * slope) / sum(n), 4), round(sum(n * intercept) / sum(n), 3), CAST(sum(n) AS BIGINT), NULL FROM fit",
)
def m22(spark, sf):
    """A line for each survey, and their mean weighted by rows."""
    fits = velocity.binned_fit(_valid(spark, sf), ["survey"], "err", "rv", 1)
    rows = [(k[0], *map(float, c), n, zero) for k, (c, _, n, zero) in sorted(fits.items())]
    if rows:
        rows.append(("(all)", *velocity.pooled(fits)[0], sum(r[3] for r in rows), None))
    return spark.createDataFrame(rows, "survey string, slope double, intercept double, n long, zero double").select("survey", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n", F.round("zero", 4).alias("zero"))


@query("M25_survey_calibration")
def m25_surveys(spark, sf):
    """All features of the calibration for each survey and half, from columns that stand for them."""
    m = _valid(spark, sf).select(
        F.expr("CASE survey WHEN 'NO' THEN 'LAMOST' ELSE survey END").alias("survey"), (F.col("rv") / 100).alias("drv"), "err", (4000 + F.col("disc") * 40000).alias("Teff"), (2 + F.col("tax") * 40).alias("logg"),
        F.when(F.col("row_id") % 3 != 0, (F.col("snr") - 25) / 50).alias("FeH"), F.col("snr").alias("SNR"), (F.col("row_id") % 97).cast("double").alias("RV"),
    )
    rows = [(s, h, name, b) for (s, h), beta in velocity.survey_calibration(m).items() for name, b in beta.items()]
    return spark.createDataFrame(rows, "survey string, half string, feature string, value double")


@query("M25_normal_equations", f"WITH {SQL_MEASURE} SELECT 'slope' AS term, round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 4) AS value FROM (SELECT coalesce(disc, 0) AS x, rv AS y, 1 / (err * err) AS w FROM m WHERE rv IS NOT NULL AND err > 0)")
def m25(spark, sf):
    beta, _ = velocity.normal_equations(_valid(spark, sf), ["disc"], "rv", "err")
    return spark.createDataFrame([("slope", float(beta[1]))], "term string, value double").select("term", F.round("value", 4).alias("value"))


@query("M27_merged_velocities", f"WITH {SQL_MEASURE}, {_VALID}, {_MEANS}, g AS (SELECT star, count(*) AS n, sum(rv / (err * err)) / sum(1 / (err * err)) AS mean, sum(1 / (err * err)) AS sw FROM mean GROUP BY star HAVING count(*) >= 2) SELECT star, max(n) AS n_surveys, round(max(mean), 4) AS rv, round(1 / sqrt(max(sw)), 5) AS d, round(sum(pow(rv - mean, 2) / (err * err)) / ((max(n) - 1) * max(sw)), 2) AS s2 FROM mean JOIN g USING (star) GROUP BY star")
def m27(spark, sf):
    out = robust.mean_error_and_scatter(velocity.survey_means(_valid(spark, sf)), ["star"], "rv", "err")
    return out.select("star", F.col("n").alias("n_surveys"), F.round("mean", 4).alias("rv"), F.round("d", 5).alias("d"), F.round("s2", 2).alias("s2"))


@query("M7_mixture_comparison")
def m7(spark, sf):
    return mixture.compare(measurements(spark, sf).withColumn("x", F.col("err") / 20), "x", 0.0, 10.0)


@query("M8_purity_columns")
def m8(spark, sf):
    m = measurements(spark, sf).withColumns({"x": F.col("err") / 20, "y": stats.relative_error(F.col("err"), F.col("rv"))})
    columns = {}
    for name, fit, v in (("p_x", mixture.fit_lognormal, "x"), ("p_y", mixture.fit_gamma, "y")):
        model = fit(m, v)
        columns[name] = model.purity(F.col(v)) if model else F.lit(None).cast("double")
    return m.withColumns(columns).select("row_id", F.round(mixture.combined_purity(list(columns)), 5).alias("purity"))


@query("M6_deconvolved_mixture")
def m6(spark, sf):
    model = mixture.fit_deconvolved(detections(spark, sf), "plx", "e_plx", -5.0, 20.0)
    return spark.createDataFrame([(model.share, *model.core, *model.tail, model.n_iter)], "share double, core_mean double, core_std double, tail_mean double, tail_std double, n_iter int")


def _catalogue(spark, sf):
    """Stars, and the objects that they may belong to."""
    d = detections(spark, sf).select("id", "ra", "dec", "pmra", "pmdec", F.lit(0.1).alias("e_pmra"), F.lit(0.1).alias("e_pmdec"), F.lit(0.0).alias("rho"), "rv", F.col("err").alias("e_rv"), F.col("plx").alias("dist"), F.col("e_plx").alias("e_dist"))
    o = stars(spark, sf).select(F.col("name").alias("object"), F.col("ra").alias("o_ra"), F.col("dec").alias("o_dec"), F.lit(60.0).alias("rhalf_arcmin"), F.lit(0.2).alias("ellipticity"), F.lit(15.0).alias("pa"), F.col("pmra").alias("ref_pmra"), F.col("pmdec").alias("ref_pmdec"), F.col("plx").alias("ref_dist"), F.element_at(F.array(*map(F.lit, ("GC", "OC", "DW", "SGR"))), (F.col("id") % 4 + 1).cast("int")).alias("kind"))
    return d, o


def _candidates(spark, sf):
    return membership.candidates(*_catalogue(spark, sf), 3.0)


def members(spark, sf, method=None):
    return whole_objects.members(*_catalogue(spark, sf), 3.0, method)


@query("M14_bayesian_membership")
def m14(spark, sf):
    return members(spark, sf, "GC")


@query("M10_density_membership")
def m10(spark, sf):
    return members(spark, sf, "OC")


@query("M10_hierarchical_membership")
def m10_hierarchical(spark, sf):
    return members(spark, sf, "HDBSCAN")


@query("M9_mixture_membership")
def m9(spark, sf):
    return members(spark, sf, "GMM")


@query("M17_quality_flags")
def m17(spark, sf):
    return whole_objects.flags(*_catalogue(spark, sf), 3.0, "OC", (0.0, 100.0))


@query("M13_method_by_type")
def m13(spark, sf):
    return members(spark, sf)
