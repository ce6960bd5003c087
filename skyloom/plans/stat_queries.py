"""Queries of aggregates, bins, sweeps, windows, sets and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import binning, keyed_join, positions, quantiles, robust
from ..sources import columns, sinks
from ..streaming import histogram as growing
from .adapters import SQL_MEASURE, SQL_SEEN, SQL_STAR, detections, measurements, read, stars

QUERIES: dict = {}


def query(name, sql=None):
    return lambda f: QUERIES.setdefault(name, (f, sql)) and f


@query("A1_inverse_variance_mean", f"WITH {SQL_MEASURE} SELECT star, survey, round(sum(rv / (err * err)) / sum(1 / (err * err)), 5) AS mean, round(1 / sqrt(sum(1 / (err * err))), 6) AS err FROM m WHERE rv IS NOT NULL AND err > 0 GROUP BY 1, 2")
def a1(spark, sf):
    m, e = robust.inverse_variance(F.col("rv"), F.col("err"))
    return measurements(spark, sf).groupBy("star", "survey").agg(F.round(m, 5).alias("mean"), F.round(e, 6).alias("err")).filter("mean IS NOT NULL")


_A2 = """k AS (SELECT *, err IS NOT NULL AND err > 0 AS ok FROM m WHERE rv IS NOT NULL), one AS (SELECT star, count(*) AS n, count(*) FILTER (ok) AS ne, avg(rv) AS av, stddev_pop(rv) AS sd, sum(rv / (err * err)) FILTER (ok) / sum(1 / (err * err)) FILTER (ok) AS wm FROM k GROUP BY star),
two AS (SELECT star, count(*) FILTER (ok AND abs(rv - wm) <= 3 * err) AS inside, count(*) FILTER (ok AND abs(rv - wm) > 3 * err) AS outside, sum(rv / (err * err)) FILTER (ok AND abs(rv - wm) <= 3 * err) / sum(1 / (err * err)) FILTER (ok AND abs(rv - wm) <= 3 * err) AS m, 1 / sqrt(sum(1 / (err * err)) FILTER (ok AND abs(rv - wm) <= 3 * err)) AS e FROM k JOIN one USING (star) GROUP BY star)"""


@query(
    "A2_clipped_weighted_mean",
    f"WITH {SQL_MEASURE}, {_A2} SELECT star, n, round(CASE WHEN ne = 0 THEN av WHEN ne = 1 THEN m WHEN inside > 0 THEN m ELSE av END, 5) AS mean, round(CASE WHEN ne = 0 THEN NULL WHEN ne = 1 OR inside > 0 THEN e ELSE sd END, 5) AS err, CASE WHEN ne > 1 AND inside > 0 THEN outside ELSE 0 END AS n_outliers FROM one JOIN two USING (star)",
)
def a2(spark, sf):
    out = robust.clipped_weighted_mean(measurements(spark, sf), ["star"], "rv", "err")
    return out.select("star", "n", F.round("mean", 5).alias("mean"), F.round("err", 5).alias("err"), "n_outliers")


_MAD = "med AS (SELECT star, count(*) AS n, median(rv) AS med FROM m WHERE rv IS NOT NULL GROUP BY star), mad AS (SELECT star, median(abs(rv - med)) AS mad FROM m JOIN med USING (star) WHERE rv IS NOT NULL GROUP BY star)"


@query(
    "A3_mad_clipped_mean",
    f"WITH {SQL_MEASURE}, {_MAD}, c AS (SELECT star, count(*) AS n, avg(rv) AS av, avg(rv) FILTER (abs(rv - med) <= 3 * 1.4826 * mad) AS inside, count(*) FILTER (abs(rv - med) > 3 * 1.4826 * mad) AS outside, max(mad) AS mad FROM m JOIN med USING (star) JOIN mad USING (star) WHERE rv IS NOT NULL GROUP BY star) SELECT star, n, round(CASE WHEN mad > 0 AND inside IS NOT NULL THEN inside ELSE av END + 1e-7, 5) AS mean, CASE WHEN mad > 0 AND inside IS NOT NULL THEN outside ELSE 0 END AS n_outliers FROM c",
)
def a3(spark, sf):
    return robust.mad_clipped_mean(measurements(spark, sf), ["star"], "rv").select("star", "n", F.round(F.col("mean") + 1e-7, 5).alias("mean"), "n_outliers")  # off the exact halves of rounding


@query("A4_first_known_value", f"WITH {SQL_SEEN} SELECT id, round(coalesce(plx, rv * 0.001), 7) AS v, round(CASE WHEN plx IS NOT NULL THEN e_plx ELSE err * 0.001 END, 7) AS e FROM seen")
def a4(spark, sf):
    v, e = robust.first_known([(F.col("plx"), F.col("e_plx"), 1.0), (F.col("rv"), F.col("err"), 0.001)])
    return detections(spark, sf).select("id", F.round(v, 7).alias("v"), F.round(e, 7).alias("e"))


@query("A5_union_of_measurements", f"WITH {SQL_SEEN}, u AS (SELECT star, plx AS value, e_plx AS error FROM seen WHERE plx IS NOT NULL UNION ALL SELECT star, rv * 0.001, err * 0.001 FROM seen) SELECT star, count(*) AS n, round(sum(value), 5) AS total, count(error) AS n_err FROM u GROUP BY star")
def a5(spark, sf):
    u = robust.stacked(detections(spark, sf), ["star"], [("plx", "e_plx", 1.0), ("rv", "err", 0.001)])
    return u.groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"), F.count("error").alias("n_err"))


@query("A7_joined_texts_and_ids", f"WITH {SQL_SEEN} SELECT star, string_agg(DISTINCT trim(survey), ',' ORDER BY trim(survey)) AS surveys, 'id:' || array_to_string(list_transform(list_sort(list(DISTINCT id)), lambda x: CAST(x AS VARCHAR)), '; id:') AS ids FROM seen GROUP BY star")
def a7(spark, sf):
    return detections(spark, sf).groupBy("star").agg(robust.joined_text(F.col("survey")).alias("surveys"), robust.joined_ids(["id"]).alias("ids"))


@query("A10_group_sizes", f"WITH {SQL_SEEN}, g AS (SELECT star, count(*) AS n FROM seen GROUP BY star) SELECT count(*) AS n_groups, max(n) AS largest, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS share_merged FROM g")
def a10(spark, sf):
    g = detections(spark, sf).groupBy("star").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share_merged"))


@query("A11_median_and_mad", f"WITH {SQL_MEASURE}, {_MAD} SELECT star, n, round(med, 5) AS median, round(1.4826 * mad, 5) AS mad FROM med JOIN mad USING (star)")
def a11(spark, sf):
    return robust.median_mad(measurements(spark, sf), ["star"], "rv", robust.SCALE).select("star", "n", F.round("median", 5).alias("median"), F.round("mad", 5).alias("mad"))


@query("A12_moments", f"WITH {SQL_MEASURE} SELECT survey, round(avg(rv), 5) AS mean, round(stddev_pop(rv), 5) AS pop, round(stddev_samp(rv), 5) AS samp FROM m GROUP BY survey")
def a12(spark, sf):
    return measurements(spark, sf).groupBy("survey").agg(F.round(F.avg("rv"), 5).alias("mean"), F.round(F.stddev_pop("rv"), 5).alias("pop"), F.round(F.stddev_samp("rv"), 5).alias("samp"))


@query("A13_percentiles", f"WITH {SQL_MEASURE} SELECT survey, round(quantile_cont(rv, 0.01), 5) AS p1, round(quantile_cont(rv, 0.9), 5) AS p90 FROM m WHERE rv IS NOT NULL GROUP BY survey")
def a13(spark, sf):
    out = quantiles.quantiles(measurements(spark, sf), ["survey"], "rv", {"p1": 0.01, "p90": 0.9})
    return out.select("survey", F.round("p1", 5).alias("p1"), F.round("p90", 5).alias("p90"))


@query("A14_radial_profile", f"WITH {SQL_MEASURE}, b AS (SELECT CAST(floor(rv / 50) AS BIGINT) AS bin, snr / 50 AS p FROM m WHERE rv >= 0 AND rv < 1000) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean, round(avg(CASE WHEN p > 0.8 THEN 1e0 ELSE 0e0 END), 6) AS share_high, round(median(p), 6) AS median FROM b GROUP BY bin HAVING count(*) >= 10")
def a14(spark, sf):
    out = binning.profile(measurements(spark, sf).withColumn("p", F.col("snr") / 50), "rv", "p", 0, 1000, 20)
    return out.select("bin", "n", *(F.round(c, 6).alias(c) for c in ("mean", "share_high", "median")))


CUTS = [5.0, 10.0, 20.0, 35.0, 50.5]
_CUTS = f"cuts AS (SELECT unnest({CUTS}) AS cut)"


@query("A15_threshold_sweep", f"WITH {SQL_MEASURE}, {_CUTS} SELECT cut, count(*) FILTER (snr < cut) AS n, round(count(*) FILTER (snr < cut) / count(*), 6) AS retention, round(avg(rv) FILTER (snr < cut), 4) AS mean_score, round(sum(rv) FILTER (snr < cut) / sum(rv), 6) AS score_share FROM m CROSS JOIN cuts WHERE rv IS NOT NULL GROUP BY cut")
def a15(spark, sf):
    out = binning.sweep(measurements(spark, sf).filter("rv IS NOT NULL"), "snr", "rv", CUTS)
    return out.select("cut", "n", F.round("retention", 6).alias("retention"), F.round("mean_score", 4).alias("mean_score"), F.round("score_share", 6).alias("score_share"))


@query("A16_sweep_by_log_bin", f"WITH {SQL_MEASURE}, {_CUTS}, b AS (SELECT *, CAST(floor(ln(rv) * 4) AS BIGINT) AS bin FROM m WHERE rv > 0) SELECT bin, cut, count(*) FILTER (snr < cut) AS n, round(count(*) FILTER (snr < cut) / count(*), 6) AS retention FROM b CROSS JOIN cuts GROUP BY bin, cut")
def a16(spark, sf):
    rows = measurements(spark, sf).filter("rv > 0").withColumn("bin", F.floor(F.log("rv") * 4))
    return binning.sweep(rows, "snr", "rv", CUTS, ["bin"]).select("bin", "cut", "n", F.round("retention", 6).alias("retention"))


@query("A17_completeness", f"WITH {SQL_SEEN}, k AS (SELECT survey, count(*) AS n_known, count(*) FILTER (err < 2) AS n_found FROM seen GROUP BY survey UNION ALL SELECT 'all', count(*), count(*) FILTER (err < 2) FROM seen) SELECT survey, n_known, n_found, round(n_found / n_known, 7) AS completeness, round(sqrt(n_found / n_known * (1 - n_found / n_known) / n_known), 7) AS error FROM k")
def a17(spark, sf):
    k = detections(spark, sf).rollup("survey").agg(F.count(F.lit(1)).alias("n_known"), F.count(F.when(F.col("err") < 2, 1)).alias("n_found"))
    c = F.col("n_found") / F.col("n_known")
    return k.select(F.coalesce("survey", F.lit("all")).alias("survey"), "n_known", "n_found", F.round(c, 7).alias("completeness"), F.round(F.sqrt(c * (1 - c) / F.col("n_known")), 7).alias("error"))


@query("A18_completeness_by_cut", f"WITH {SQL_SEEN}, c AS (SELECT unnest([1e0, 2e0, 3e0, 4e0]) AS cut) SELECT survey, cut, round(count(*) FILTER (err < cut) / count(*), 7) AS completeness FROM seen CROSS JOIN c GROUP BY survey, cut")
def a18(spark, sf):
    return binning.sweep(detections(spark, sf), "err", "err", [1.0, 2.0, 3.0, 4.0], ["survey"]).select("survey", "cut", F.round("retention", 7).alias("completeness"))


_PR = "pr AS (SELECT k, count(*) FILTER (p >= k / 20e0 - 1e-9 / 20) AS n, sum(p) FILTER (p >= k / 20e0 - 1e-9 / 20) AS s, sum(p) AS t FROM (SELECT snr / 50 AS p FROM m) CROSS JOIN (SELECT unnest(range(21)) AS k) GROUP BY k), q AS (SELECT k, CASE WHEN n > 0 THEN s / n ELSE 1 END AS precision, CASE WHEN n > 0 THEN s / t ELSE 0 END AS recall FROM pr)"


@query("A19_precision_recall", f"WITH {SQL_MEASURE}, {_PR} SELECT round(k / 20e0, 4) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce((recall - lead(recall) OVER (ORDER BY k)) * (precision + lead(precision) OVER (ORDER BY k)) / 2, 0), 6) AS area FROM q")
def a19(spark, sf):
    out = binning.precision_recall(measurements(spark, sf).withColumn("p", F.col("snr") / 50), "p", 21)
    return out.select(F.round("threshold", 4).alias("threshold"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "area")))


@query("A20_best_f1", f"WITH {SQL_MEASURE}, {_PR}, f AS (SELECT k, 2 * precision * recall / (precision + recall) AS f1 FROM q) SELECT round(arg_max(k, f1) / 20e0, 4) AS threshold, round(max(f1), 6) AS f1 FROM f")
def a20(spark, sf):
    p, r = F.col("precision"), F.col("recall")
    out = binning.precision_recall(measurements(spark, sf).withColumn("p", F.col("snr") / 50), "p", 21).withColumn("f1", 2 * p * r / (p + r))
    return out.agg(F.round(F.max_by("threshold", "f1"), 4).alias("threshold"), F.round(F.max("f1"), 6).alias("f1"))


_SPAN = "span AS (SELECT survey, quantile_cont(rv, 0.01) AS lo, quantile_cont(rv, 0.99) AS hi FROM m WHERE rv IS NOT NULL AND err IS NOT NULL GROUP BY survey HAVING count(*) >= 20)"


@query(
    "A21_binned_median",
    f"WITH {SQL_MEASURE}, {_SPAN}, b AS (SELECT survey, least(CAST(floor((rv - lo) / ((hi - lo) / 12)) AS BIGINT), 11) AS bin, err FROM m JOIN span USING (survey) WHERE rv >= lo AND rv < hi AND err IS NOT NULL), c AS (SELECT survey, bin, count(*) AS n, median(err) AS med FROM b GROUP BY 1, 2 HAVING count(*) >= 10) SELECT survey, bin, n, med AS median, median(abs(err - med)) AS mad FROM b JOIN c USING (survey, bin) GROUP BY ALL",
)
def a21(spark, sf):
    return binning.binned_median(measurements(spark, sf), ["survey"], "rv", "err", 12).select("survey", "bin", "n", "median", "mad")


@query("A24_histogram_density", f"WITH {SQL_MEASURE}, b AS (SELECT survey, least(CAST(floor((snr - 1) / 4.9e0) AS BIGINT), 9) AS bin, count(*) AS n FROM m WHERE snr BETWEEN 1 AND 50 GROUP BY 1, 2) SELECT survey, bin, round(n / (sum(n) OVER (PARTITION BY survey) * 4.9e0), 8) AS density FROM b")
def a24(spark, sf):
    return binning.histogram(measurements(spark, sf), "snr", 1, 50, 10, ["survey"], density=True).select("survey", "bin", F.round("density", 8).alias("density"))


@query("A25_histogram_2d", f"WITH {SQL_MEASURE} SELECT least(CAST(floor((snr - 1) / 4.9e0) AS BIGINT), 9) AS bx, least(CAST(floor(disc / (0.1e0 / 4)) AS BIGINT), 3) AS by, count(*) AS count, round(avg(rv), 4) AS mean_rv FROM m WHERE snr BETWEEN 1 AND 50 AND disc BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def a25(spark, sf):
    return binning.histogram_2d(measurements(spark, sf), "snr", "disc", (1, 50, 10), (0, 0.1, 4), {"mean_rv": F.round(F.avg("rv"), 4)})


@query("A26_binned_mean", f"WITH {SQL_MEASURE} SELECT least(greatest(CAST(ceil((rv - 0) / (1000e0 / 20)) AS BIGINT) - 1, 0), 19) AS bin, count(*) AS n, round(sum(err) / count(*), 6) AS mean FROM m WHERE rv IS NOT NULL AND err IS NOT NULL GROUP BY 1")
def a26(spark, sf):
    return binning.binned_mean(measurements(spark, sf), "rv", "err", 0, 1000, 20).select("bin", "n", F.round("mean", 6).alias("mean"))


@query("A27_pixel_statistics", f"WITH {SQL_SEEN} SELECT CAST(floor(ra) AS BIGINT) % 360 * 180 + CAST(floor(dec + 90) AS BIGINT) % 180 AS pixel, survey, count(*) AS n, round(avg(rv), 4) AS mean_rv, count(plx) AS n_plx FROM seen GROUP BY 1, 2")
def a27(spark, sf):
    from ..functions.sky import degree_pixel

    return detections(spark, sf).groupBy(degree_pixel(F.col("ra"), F.col("dec")).alias("pixel"), "survey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rv"), 4).alias("mean_rv"), F.count("plx").alias("n_plx"))


@query("A28_cumulative_and_mode", f"WITH {SQL_MEASURE}, b AS (SELECT least(CAST(floor((snr - 1) / 4.9e0) AS BIGINT), 9) AS bin, count(*) AS count FROM m WHERE snr BETWEEN 1 AND 50 GROUP BY 1) SELECT bin, count, CAST(sum(count) OVER (ORDER BY bin) AS BIGINT) AS cumulative FROM b")
def a28(spark, sf):
    return binning.cumulative(binning.histogram(measurements(spark, sf), "snr", 1, 50, 10), "bin", "count")


@query("A30_best_value", f"WITH {SQL_MEASURE} SELECT star, round(coalesce(max(CASE WHEN survey = 'RF' THEN rv END), sum(CASE WHEN err > 0 THEN rv / (err * err) END) / sum(CASE WHEN err > 0 AND rv IS NOT NULL THEN 1 / (err * err) END), avg(rv)), 5) AS best FROM m GROUP BY star")
def a30(spark, sf):
    m, _ = robust.inverse_variance(F.col("rv"), F.col("err"))
    return measurements(spark, sf).groupBy("star").agg(F.round(F.coalesce(F.max(F.when(F.col("survey") == "RF", F.col("rv"))), m, F.avg("rv")), 5).alias("best"))


@query("A31_error_and_scatter", f"WITH {SQL_MEASURE}, k AS (SELECT star, rv, 1 / (err * err) AS w FROM m WHERE rv IS NOT NULL AND err > 0), g AS (SELECT star, count(*) AS n, sum(w * rv) / sum(w) AS mean, sum(w) AS sw FROM k GROUP BY star HAVING count(*) >= 2) SELECT star, max(n) AS n, round(max(mean), 5) AS mean, round(1 / sqrt(max(sw)), 6) AS d, round(sum(w * pow(rv - mean, 2)) / ((max(n) - 1) * max(sw)), 3) AS s2 FROM k JOIN g USING (star) GROUP BY star")
def a31(spark, sf):
    out = robust.mean_error_and_scatter(measurements(spark, sf), ["star"], "rv", "err")
    return out.select("star", "n", F.round("mean", 5).alias("mean"), F.round("d", 6).alias("d"), F.round("s2", 3).alias("s2"))


@query("A32_weighted_covariance", f"WITH {SQL_MEASURE}, k AS (SELECT survey, rv AS x, err AS y, snr AS w FROM m WHERE rv IS NOT NULL AND err IS NOT NULL), g AS (SELECT survey, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM k GROUP BY survey) SELECT survey, round(sum(w * (x - mx) * (x - mx)) / sum(w), 3) AS xx, round(sum(w * (x - mx) * (y - my)) / sum(w), 3) AS xy, round(sum(w * (y - my) * (y - my)) / sum(w), 4) AS yy FROM k JOIN g USING (survey) GROUP BY survey")
def a32(spark, sf):
    return robust.weighted_covariance(measurements(spark, sf), ["survey"], "rv", "err", "snr").select("survey", F.round("xx", 3).alias("xx"), F.round("xy", 3).alias("xy"), F.round("yy", 4).alias("yy"))


@query("A35_groups_of_a_size", f"WITH {SQL_SEEN} SELECT star, count(*) AS n FROM seen GROUP BY star HAVING count(*) >= 12")
def a35(spark, sf):
    return binning.smallest_groups_out(detections(spark, sf), ["star"], 12).groupBy("star").agg(F.count(F.lit(1)).alias("n"))


@query("F2_quality_ranges", f"WITH {SQL_SEEN} SELECT id FROM seen WHERE err > 0 AND err < 4 AND abs(err / rv) > 0 AND abs(err / rv) < 10 AND plx IS NOT NULL")
def f2(spark, sf):
    rel = stats.relative_error(F.col("err"), F.col("rv"))
    return detections(spark, sf).dropna(subset=["plx"]).filter((F.col("err") > 0) & (F.col("err") < 4) & (rel > 0) & (rel < 10)).select("id")


@query("F5_chi_square_selection", f"WITH {SQL_SEEN} SELECT id FROM seen WHERE pow(plx - 5, 2) / (4 + e_plx * e_plx) + pow(rv - 20, 2) / (2500 + err * err) < 6 AND e_plx / plx < 0.2 AND plx > 0")
def f5(spark, sf):
    chi = F.pow(F.col("plx") - 5, 2) / (4 + F.col("e_plx") * F.col("e_plx")) + F.pow(F.col("rv") - 20, 2) / (2500 + F.col("err") * F.col("err"))
    return detections(spark, sf).filter((chi < 6) & (F.col("plx") > 0) & (F.try_divide("e_plx", "plx") < 0.2)).select("id")


@query("F6_foreground_removal", f"WITH {SQL_SEEN} SELECT id, survey FROM seen WHERE NOT coalesce(plx - 3 * e_plx > 0.10, false)")
def f6(spark, sf):
    return detections(spark, sf).filter(~F.coalesce(F.col("plx") - 3 * F.col("e_plx") > 0.10, F.lit(False))).select("id", "survey")


@query("F9_percentile_clip", f"WITH {SQL_MEASURE}, s AS (SELECT survey, quantile_cont(rv, 0.01) AS lo, quantile_cont(rv, 0.99) AS hi, count(*) AS n FROM m WHERE rv IS NOT NULL GROUP BY survey) SELECT survey, row_id FROM m JOIN s USING (survey) WHERE n < 3 OR rv BETWEEN lo AND hi")
def f9(spark, sf):
    return binning.percentile_clip(measurements(spark, sf), "rv", ["survey"]).select("survey", "row_id")


@query("F15_quality_inflation", f"WITH {SQL_SEEN} SELECT id, round(CASE WHEN err > 4 THEN e_plx * 3 ELSE e_plx END, 6) AS e_plx, round(CASE WHEN err IS NULL OR err <= 0 THEN 5 WHEN err / abs(rv) > 1 THEN err * 5 ELSE err END, 6) AS err, err > 4 OR err / abs(rv) > 1 AS outlier FROM seen WHERE rv <> 0")
def f15(spark, sf):
    bad, low = F.col("err") > 4, F.col("err") / F.abs("rv") > 1
    e = F.when(F.col("err").isNull() | (F.col("err") <= 0), 5.0).when(low, F.col("err") * 5).otherwise(F.col("err"))
    return detections(spark, sf).filter("rv <> 0").select("id", F.round(F.when(bad, F.col("e_plx") * 3).otherwise(F.col("e_plx")), 6).alias("e_plx"), F.round(e, 6).alias("err"), (bad | low).alias("outlier"))


@query("J7_enrich_by_extracted_id", "WITH e AS (SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '\"k\": ?(\\d+)', 1), '') AS BIGINT) AS c_custkey FROM events), f AS (SELECT c_custkey, arg_min(c_name, c_name) AS name FROM customer GROUP BY c_custkey) SELECT event_id, e.c_custkey, name FROM e LEFT JOIN f USING (c_custkey)")
def j7(spark, sf):
    found = F.regexp_extract("props", r'"k": ?(\d+)', 1)
    e = read(spark, sf, "events").select("event_id", F.when(found != "", found.try_cast("long")).alias("c_custkey"))
    lookup = read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return keyed_join.enrich(e, lookup, "c_custkey", ["name"]).select("event_id", "c_custkey", "name")


@query("J8_id_map_with_fallback", "WITH k AS (SELECT l_orderkey AS key, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) AS gid FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) SELECT o_orderkey AS id, coalesce(k.gid, o_custkey) AS gid FROM orders LEFT JOIN k ON key = o_orderkey")
def j8(spark, sf):
    by_id = read(spark, sf, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("gid"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("order"))
    orders = read(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("key"))
    return keyed_join.id_or_place(rows, by_id, orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gid"))).select("id", "gid")


@query("J10_shared_members", f"WITH {SQL_MEASURE}, d AS (SELECT DISTINCT survey, star FROM m) SELECT x.survey AS a, y.survey AS b, count(*) AS n_shared FROM d x JOIN d y ON x.star = y.star AND x.survey < y.survey GROUP BY 1, 2")
def j10(spark, sf):
    return keyed_join.shared_members(measurements(spark, sf), "survey", "star")


@query("J11_name_variants", "SELECT c_custkey AS id, c_name AS matched FROM customer")
def j11(spark, sf):
    """Names written in several ways, matched back to the catalogue's."""
    c = read(spark, sf, "customer")
    written = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.lower("c_name"))
    out = keyed_join.by_name(c.select(F.col("c_custkey").alias("id"), written.alias("written")), c.select("c_name"), "written", "c_name")
    return out.select("id", F.col("matched_name").alias("matched"))


@query("J13_name_containment", "WITH a AS (SELECT DISTINCT lower(p_type) AS l FROM part), b AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS r FROM part UNION SELECT DISTINCT lower(split_part(p_type, ' ', 2)) FROM part) SELECT l, r FROM a JOIN b ON contains(l, r) OR contains(r, l) WHERE length(l) >= 4 AND length(r) >= 4")
def j13(spark, sf):
    p = read(spark, sf, "part")
    a = p.select(F.lower("p_type").alias("l"))
    part = F.split("p_type", " ")
    b = p.select(F.lower(F.get(part, F.lit(0))).alias("r")).union(p.select(F.lower(F.get(part, F.lit(1)))))
    return keyed_join.by_containment(a, b, "l", "r")


@query("J15_semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def j15(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("W1_keep_first", f"WITH {SQL_MEASURE}, v AS (SELECT * FROM m WHERE rv IS NOT NULL AND err > 0 AND abs(abs(rv) - abs(err)) >= 1e-6) SELECT survey, min(row_id) AS row_id FROM v GROUP BY survey, round_even(rv, 6), round_even(err, 6)")
def w1(spark, sf):
    from ..operators.velocity import without_copies

    return without_copies(measurements(spark, sf)).select("survey", "row_id")


@query("W2_best_of_group", f"WITH {SQL_MEASURE} SELECT star, row_id, rank FROM (SELECT star, row_id, CAST(row_number() OVER (PARTITION BY star ORDER BY err, row_id) AS INTEGER) AS rank FROM m WHERE err IS NOT NULL) WHERE rank <= 5")
def w2(spark, sf):
    return keyed_join.top_per_group(measurements(spark, sf).filter("err IS NOT NULL"), ["star"], ["err", "row_id"], 5).select("star", "row_id", "rank")


@query("W5_nearest_in_group", f"WITH {SQL_MEASURE} SELECT star, arg_min(row_id, [abs(rv - 300), row_id]) AS row_id FROM m WHERE rv IS NOT NULL GROUP BY star")
def w5(spark, sf):
    return measurements(spark, sf).filter("rv IS NOT NULL").groupBy("star").agg(F.min_by("row_id", F.struct(F.abs(F.col("rv") - 300), "row_id")).alias("row_id"))


@query("W6_pages", f"WITH {SQL_STAR} SELECT id, CAST((row_number() OVER (PARTITION BY kind ORDER BY mag DESC, id) - 1) // 9 AS BIGINT) AS page FROM star")
def w6(spark, sf):
    ranked = positions.numbered(stars(spark, sf).select("id", "kind", "mag"), [F.desc("mag"), "id"], by=["kind"])
    return ranked.select("id", F.expr("position div 9").alias("page"))


@query("O2_topped_up_selection", f"WITH {SQL_STAR}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mag < 9000, mag DESC, id) AS k, count(*) FILTER (mag >= 9000) OVER (PARTITION BY kind) AS n FROM star WHERE mag >= 5000) SELECT id, kind FROM r WHERE k <= greatest(n, 5)")
def o2(spark, sf):
    """All stars over a strict bound, topped up to five a kind from those over a relaxed one."""
    s = stars(spark, sf)
    strict = s.filter("mag >= 9000")
    n = strict.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    relaxed = positions.numbered(s.filter("mag >= 5000 AND mag < 9000").select("id", "kind", "mag"), [F.desc("mag"), "id"], by=["kind"])
    more = relaxed.join(n, "kind", "left").filter("position < 5 - coalesce(n, 0)")
    return strict.select("id", "kind").union(more.select("id", "kind"))


@query("O5_seeded_sample", f"WITH {SQL_STAR} SELECT id, kind FROM star ORDER BY md5(concat(id, ':', 42)), id LIMIT 100")
def o5(spark, sf):
    return keyed_join.seeded_sample(stars(spark, sf).select("id", "kind"), "id", 100)


@query("U1_union_by_name", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def u1(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), allowMissingColumns=True)


@query("U2_set_operations", "SELECT 'both' AS which, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u2(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select("o_custkey")
    n = lambda df, w: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("which"), "n")
    return n(o.intersect(c), "both").union(n(c.subtract(o), "only"))


@query("X14_survey_resolver", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'GAIA' WHEN contains(o_orderpriority, 'HIGH') THEN 'APOGEE' WHEN contains(o_orderpriority, 'MED') THEN 'GALAH' ELSE 'OTHER' END AS survey FROM orders")
def x14(spark, sf):
    rules = (("prefix", "1", "GAIA"), ("contains", "HIGH", "APOGEE"), ("contains", "MED", "GALAH"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.resolve(F.col("o_orderpriority"), rules).alias("survey"))


@query("X15_survey_regex", "SELECT p_partkey AS id, CASE WHEN regexp_matches(p_type, '(?i)steel|tin') THEN 'metal' WHEN regexp_matches(p_type, '(?i)^prom') THEN 'promo' END AS kind FROM part")
def x15(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.resolve_regex(F.col("p_type"), [("steel|tin", "metal"), ("^prom", "promo")]).alias("kind"))


@query("X16_plain_names", "SELECT c_custkey AS id, regexp_replace(lower(trim(c_name)), '[^a-z0-9]', '', 'g') AS name FROM customer")
def x16(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.plain_name(F.col("c_name")).alias("name"))


@query("X18_sexagesimal", "SELECT o_orderkey AS id, round((o_orderkey % 24 + (o_orderkey % 60) / 60e0 + (o_orderkey % 55) / 3600e0) * 15, 7) AS ra, round((o_orderkey % 89 + (o_orderkey % 60) / 60e0) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END, 7) AS dec FROM orders")
def x18(spark, sf):
    k = F.col("o_orderkey")
    hms = F.concat_ws(":", k % 24, k % 60, k % 55)
    dms = F.concat(F.when(k % 2 == 0, "-").otherwise("+"), (k % 89).cast("string"), F.lit(" "), (k % 60).cast("string"))
    return read(spark, sf, "orders").select(k.alias("id"), F.round(text.sexagesimal(hms, True), 7).alias("ra"), F.round(text.sexagesimal(dms), 7).alias("dec"))


@query("X20_posteriors", f"WITH {SQL_MEASURE}, p AS (SELECT row_id, 0.7 * exp(-0.5 * pow((ln(err) - 2) / 0.5, 2)) / (0.5 * err) AS c, 0.3 * exp(-0.5 * pow((ln(err) - 3) / 0.8, 2)) / (0.8 * err) AS t FROM m) SELECT row_id, round(coalesce(c / (c + t), 0.5), 6) AS p FROM p")
def x20(spark, sf):
    e = F.col("err")
    return measurements(spark, sf).select("row_id", F.round(stats.posterior(stats.lognormal_logpdf(e, 2.0, 0.5), stats.lognormal_logpdf(e, 3.0, 0.8), 0.7), 6).alias("p"))


@query("X24_polynomial_and_error", f"WITH {SQL_SEEN} SELECT id, round(0.01 * plx * plx - 0.2 * plx + 1, 7) AS y, round(CASE WHEN sqrt(1e-4 * pow(plx, 4) + 2e-3 * pow(plx, 2) + 0.01) <= 5 THEN sqrt(1e-4 * pow(plx, 4) + 2e-3 * pow(plx, 2) + 0.01) END, 7) AS e FROM seen")
def x24(spark, sf):
    cov = [[1e-4, 0, 0], [0, 2e-3, 0], [0, 0, 0.01]]
    return detections(spark, sf).select("id", F.round(stats.polynomial(F.col("plx"), [0.01, -0.2, 1.0]), 7).alias("y"), F.round(stats.polynomial_error(F.col("plx"), cov), 7).alias("e"))


@query("S16_column_aliases", "SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS mag, NULL::DOUBLE AS ruwe FROM customer")
def s16(spark, sf):
    out = columns.with_aliases(read(spark, sf, "customer").withColumnRenamed("c_custkey", "id"), {"mag": ["Gmag", "C_ACCTBAL"], "ruwe": ["RUWE_final"]})
    return out.select("id", "mag", "ruwe")


@query("K6_json_rows", f"""WITH {SQL_STAR} SELECT concat('{{"id":', id, ',"name":"', name, '","plx":', coalesce(CAST(CASE WHEN id % 7 <> 0 THEN plx END AS VARCHAR), 'null'), '}}') AS json FROM star""")
def k6(spark, sf):
    return sinks.json_rows(stars(spark, sf).select("id", "name", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("plx")).alias("plx")))


@query("Z5_reference_distance", f"WITH {SQL_SEEN}, g AS (SELECT star, count(*) AS n, median(plx) AS med FROM seen WHERE plx > 0 AND plx < 100 GROUP BY star HAVING count(*) >= 3), d AS (SELECT star, median(abs(plx - med)) AS mad FROM seen JOIN g USING (star) WHERE plx > 0 AND plx < 100 GROUP BY star) SELECT star, round(1 / med, 6) AS kpc, round(CASE WHEN mad > 0 THEN mad / (med * med) ELSE 0.15 / med END, 6) AS kpc_err FROM g JOIN d USING (star)")
def z5(spark, sf):
    g = robust.median_mad(detections(spark, sf).filter("plx > 0 AND plx < 100"), ["star"], "plx").filter("n >= 3")
    m = F.col("median")
    return g.select("star", F.round(1 / m, 6).alias("kpc"), F.round(F.when(F.col("mad") > 0, F.col("mad") / (m * m)).otherwise(0.15 / m), 6).alias("kpc_err"))


@query("T1_growing_histogram", "SELECT event_type, least(CAST(floor(value / 10) AS BIGINT), 9) AS bin, count(*) AS count, round(sum(value), 4) AS total FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2")
def t1(spark, sf):
    return growing.growing_histogram(read(spark, sf, "events"), "value", 0, 100, 10, ["event_type"]).select("event_type", "bin", "count", F.round("total", 4).alias("total"))


@query("T2_hourly_means", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2")
def t2(spark, sf):
    return growing.hourly(read(spark, sf, "events"), "ts", "value", ["event_type"]).select("hour", "event_type", "n", F.round("mean", 5).alias("mean"))
