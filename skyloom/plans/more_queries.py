"""Queries of the remaining projections, filters, scalars and small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sky, stats, text
from ..operators import binning, keyed_join, mixture, positions, quantiles, robust, velocity
from ..sources import columns, sinks
from .model_queries import SQL_FITS, members
from .adapters import SQL_MEASURE, SQL_SEEN, SQL_STAR, detections, measurements, read, stars

QUERIES: dict = {}


def query(name, sql=None):
    return lambda f: QUERIES.setdefault(name, (f, sql)) and f


@query("A6_mean_position", f"WITH {SQL_SEEN} SELECT star, round((degrees(atan2(sum(cos(radians(dec)) * sin(radians(ra))), sum(cos(radians(dec)) * cos(radians(ra))))) + 360) % 360, 6) AS ra, round(avg(dec), 2) AS dec FROM seen GROUP BY star")
def a6(spark, sf):
    d = detections(spark, sf)
    return robust.mean_position(d, ["star"]).join(d.groupBy("star").agg(F.round(F.avg("dec"), 2).alias("dec_mean")), "star").select("star", F.round("ra", 6).alias("ra"), F.col("dec_mean").alias("dec"))


@query("A9_first_array", "SELECT label, arg_min(embedding[1], vec_id) AS first_value, arg_min(len(embedding), vec_id) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY label")
def a9(spark, sf):
    out = robust.first_array(read(spark, sf, "embeddings"), ["label"], "embedding", "vec_id")
    return out.select("label", F.get("embedding", F.lit(0)).alias("first_value"), F.size("embedding").cast("long").alias("n"))


@query("A22_clipped_binned_median", f"WITH {SQL_MEASURE}, b AS (SELECT CASE WHEN rv >= 0 AND rv < 200 THEN 0 WHEN rv >= 200 AND rv < 500 THEN 1 WHEN rv >= 500 AND rv < 1100 THEN 2 END AS bin, err FROM m WHERE err IS NOT NULL), s AS (SELECT bin, count(*) AS n, quantile_cont(err, 0.98) AS top FROM b WHERE bin IS NOT NULL GROUP BY bin HAVING count(*) >= 5) SELECT bin, max(n) AS n, median(err) AS median FROM b JOIN s USING (bin) WHERE err <= top GROUP BY bin HAVING count(*) >= 2")
def a22(spark, sf):
    return binning.clipped_binned_median(measurements(spark, sf), "rv", "err", [0.0, 200.0, 500.0, 1100.0])


@query("A23_binned_count_and_sum", f"WITH {SQL_MEASURE} SELECT CAST(floor(rv / 100) AS BIGINT) AS bin, count(*) AS n, round(sum(err), 4) AS total FROM m WHERE rv >= 0 AND rv < 1000 GROUP BY 1")
def a23(spark, sf):
    return measurements(spark, sf).withColumn("bin", stats.bin_half_open(F.col("rv"), 0, 1000, 10)).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("err"), 4).alias("total"))


@query("A29_summary_and_fill_rate", f"WITH {SQL_SEEN} SELECT survey, count(*) AS n, round(avg(rv), 2) AS mean, round(stddev_samp(rv), 2) AS std, round(count(plx) / count(*), 4) AS fill FROM seen GROUP BY survey")
def a29(spark, sf):
    return detections(spark, sf).groupBy("survey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rv"), 2).alias("mean"), F.round(F.stddev_samp("rv"), 2).alias("std"), F.round(F.count("plx") / F.count(F.lit(1)), 4).alias("fill"))


@query("A34_prior_factor", f"WITH {SQL_MEASURE} SELECT survey, round(median(disc * 100 / err), 6) AS factor FROM m WHERE err > 0 AND disc > 0 GROUP BY survey")
def a34(spark, sf):
    ratios = measurements(spark, sf).filter("err > 0 AND disc > 0").withColumn("ratio", F.col("disc") * 100 / F.col("err"))
    return quantiles.medians(ratios, ["survey"], "ratio", "factor").select("survey", F.round("factor", 6).alias("factor"))


@query("F3_probability_prefilter", f"WITH {SQL_MEASURE} SELECT row_id FROM m WHERE snr / 50 > 0.8")
def f3(spark, sf):
    """Kept above 0.8 where the table has the column at all."""
    m = measurements(spark, sf).withColumn("p", F.col("snr") / 50)
    return (m.filter("p > 0.8") if "p" in m.columns else m).select("row_id")


@query("F4_combined_cut", f"WITH {SQL_SEEN} SELECT id FROM seen WHERE plx > 0 AND e_plx > 0 AND e_plx / plx < 0.2 AND err > 0 AND err < 5")
def f4(spark, sf):
    return detections(spark, sf).filter((F.col("plx") > 0) & (F.col("e_plx") > 0) & (F.try_divide("e_plx", "plx") < 0.2) & F.col("err").between(1e-12, 4.999999999)).select("id")


@query("F7_sky_box_then_annulus", f"WITH {SQL_STAR} SELECT id FROM star WHERE dec BETWEEN -30 AND 50 AND ra BETWEEN 180 - 40 / greatest(cos(radians(10)), 0.1) AND 180 + 40 / greatest(cos(radians(10)), 0.1) AND degrees(2 * asin(sqrt(pow(sin(radians(dec - 10) / 2), 2) + cos(radians(10)) * cos(radians(dec)) * pow(sin(radians(ra - 180) / 2), 2)))) BETWEEN 5 AND 40")
def f7(spark, sf):
    import math

    half = 40 / max(math.cos(math.radians(10)), 0.1)
    box = stars(spark, sf).filter(F.col("dec").between(-30, 50) & F.col("ra").between(180 - half, 180 + half))
    return box.filter(sky.separation(F.lit(180.0), F.lit(10.0), F.col("ra"), F.col("dec")).between(5, 40)).select("id")


@query("F8_high_and_all", f"WITH {SQL_MEASURE} SELECT survey, count(*) AS n_all, count(*) FILTER (snr / 50 >= 0.5) AS n_high FROM m WHERE snr IS NOT NULL GROUP BY survey")
def f8(spark, sf):
    return measurements(spark, sf).filter("snr IS NOT NULL").groupBy("survey").agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("snr") / 50 >= 0.5, 1)).alias("n_high"))


@query("F10_filler_values_out", f"WITH {SQL_MEASURE} SELECT count(*) AS n FROM m WHERE NOT coalesce(abs(abs(rv) - abs(err)) < 1e-6, false)")
def f10(spark, sf):
    return measurements(spark, sf).filter(~F.coalesce(F.abs(F.abs("rv") - F.abs("err")) < 1e-6, F.lit(False))).agg(F.count(F.lit(1)).alias("n"))


@query("F12_quality_flag_default", "SELECT o_orderkey AS id, coalesce(CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END, true) AS good FROM orders")
def f12(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").try_cast("boolean"), F.lit(True)).alias("good"))


@query("F13_least_group_size", f"WITH {SQL_SEEN} SELECT id FROM seen WHERE star IN (SELECT star FROM seen GROUP BY star HAVING count(*) >= 10)")
def f13(spark, sf):
    return binning.smallest_groups_out(detections(spark, sf), ["star"], 10).select("id")


@query("F14_suffixed_columns", "SELECT c_custkey AS id, c_name AS c_name_master, c_acctbal AS c_acctbal_master, 'GC' AS obj_type FROM customer")
def f14(spark, sf):
    return columns.renamed(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal"), "_master", ("id",)).withColumn("obj_type", F.lit("GC"))


@query("F16_numeric_coercion", "SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '(\\d+)', 1), '') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events")
def f16(spark, sf):
    found = F.regexp_extract("props", r"(\d+)", 1)
    return read(spark, sf, "events").select("event_id", F.nullif(found, F.lit("")).try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("not_a_number"))


@query("J12_two_stage_names", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'normalised' END AS stage FROM part")
def j12(spark, sf):
    """Names that match as they are, then those that match once normalised."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    written = F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat(F.upper("name"), F.lit(" ")))
    w = p.select("id", written.alias("written"))
    direct = w.join(p.select(F.col("name").alias("written")).distinct(), "written", "left_semi").select("id", F.lit("direct").alias("stage"))
    rest = w.join(direct, "id", "left_anti").withColumn("k", text.plain_name(F.col("written")))
    second = rest.join(p.select(text.plain_name(F.col("name")).alias("k")).distinct(), "k", "left_semi").select("id", F.lit("normalised").alias("stage"))
    return direct.union(second)


@query("J14_columns_side_by_side", f"WITH {SQL_SEEN} SELECT d.id, d.rv, s.name FROM seen d JOIN star s ON s.id = d.star")
def j14(spark, sf):
    """Detections matched to their stars, and the stars in the same order, put side by side by position alone."""
    d = detections(spark, sf).select("id", "rv", "star")
    matched = d.join(stars(spark, sf).select(F.col("id").alias("star"), "name"), "star").select(F.col("id").alias("of"), "name")
    return positions.zipped(d.select("id", "rv"), matched, ["id"], ["of"]).select("id", "rv", "name")


@query("W3_drop_later_copies", f"WITH {SQL_SEEN} SELECT min(id) AS id, star FROM seen GROUP BY star")
def w3(spark, sf):
    return keyed_join.keep_first(detections(spark, sf).select("id", "star"), ["star"], ["id"])


@query("W4_crossover_by_lag", f"WITH {SQL_MEASURE}, h AS (SELECT least(CAST(floor((snr - 1) / 4.9e0) AS BIGINT), 9) AS bin, count(*) FILTER (disc < 0.05) AS a, count(*) FILTER (disc >= 0.05) AS b FROM m WHERE snr BETWEEN 1 AND 50 GROUP BY 1), l AS (SELECT *, lag(a >= b) OVER (ORDER BY bin) AS before FROM h) SELECT min(bin) AS bin FROM l WHERE before AND a < b")
def w4(spark, sf):
    h = measurements(spark, sf).withColumn("bin", stats.bin_last_closed(F.col("snr"), 1, 50, 10)).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.when(F.col("disc") < 0.05, 1)).alias("a"), F.count(F.when(F.col("disc") >= 0.05, 1)).alias("b"))
    before = F.lag(F.col("a") >= F.col("b")).over(Window.partitionBy(F.lit(0)).orderBy("bin"))
    return h.withColumn("before", before).filter("before AND a < b").agg(F.min("bin").alias("bin"))


@query("O1_ranked_objects", f"WITH {SQL_STAR} SELECT kind, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, count(*) DESC, kind) AS INTEGER) AS place FROM star GROUP BY kind")
def o1(spark, sf):
    order = F.when(F.col("kind") == "MACHINERY", 0).when(F.col("kind") == "BUILDING", 1).otherwise(2)
    n = stars(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, F.desc("n"), "kind")))


@query("O3_sorted_summary", f"WITH {SQL_SEEN} SELECT survey, star % 5 AS part, count(*) AS n FROM seen GROUP BY 1, 2 ORDER BY n DESC")
def o3(spark, sf):
    d = detections(spark, sf).groupBy("survey", (F.col("star") % 5).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"))


@query("U3_set_difference", "SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def u3(spark, sf):
    a = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"))
    return a.subtract(read(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select("s_suppkey"))


@query("X11_relative_errors", f"WITH {SQL_SEEN} SELECT id, round(abs(e_plx / nullif(plx, 0)), 7) AS rel, round(plx / e_plx, 6) AS snr FROM seen")
def x11(spark, sf):
    return detections(spark, sf).select("id", F.round(stats.relative_error(F.col("e_plx"), F.col("plx")), 7).alias("rel"), F.round(F.try_divide("plx", "e_plx"), 6).alias("snr"))


@query("X17_extracted_ids", "SELECT event_id, TRY_CAST(nullif(regexp_extract(props, 'k\": ?(\\d+)', 1), '') AS BIGINT) AS id FROM events")
def x17(spark, sf):
    return read(spark, sf, "events").select("event_id", text.extract_id(F.regexp_replace("props", '[" ]', ""), "k").alias("id"))


@query("X19_whole_number_text", "SELECT o_orderkey AS id, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS t FROM orders")
def x19(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.whole_number_text(F.col("o_totalprice")).alias("t"))


@query("X22_plummer_and_field", f"WITH {SQL_MEASURE} SELECT row_id, round(CASE WHEN snr / 50 <= 0.9 THEN (pow(0.3, 2) / (pow(2, 2/3e0) - 1) + 0.81) / (pi() * pow(0.3, 2) / (pow(2, 2/3e0) - 1) * 0.81) / pow(1 + pow(snr / 50, 2) / (pow(0.3, 2) / (pow(2, 2/3e0) - 1)), 2) ELSE 0 END, 7) AS plummer, round(1 / (pi() * 0.81), 7) AS field FROM m")
def x22(spark, sf):
    return measurements(spark, sf).select("row_id", F.round(stats.plummer_density(F.col("snr") / 50, 0.3, 0.9), 7).alias("plummer"), F.round(stats.uniform_density(0.9), 7).alias("field"))


@query("X23_motion_covariance", f"WITH {SQL_SEEN}, c AS (SELECT id, err * err + 1e-6 AS xx, 0.3 * err * e_plx AS xy, e_plx * e_plx + 1e-6 AS yy, pmra - 1 AS dx, pmdec + 1 AS dy FROM seen WHERE e_plx IS NOT NULL) SELECT id, round(xy, 7) AS xy, round(-0.5 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / (xx * yy - xy * xy) - 0.5 * ln(xx * yy - xy * xy) - ln(2 * pi()), 4) AS logpdf FROM c")
def x23(spark, sf):
    xx, xy, yy = stats.motion_covariance(F.col("err"), F.col("e_plx"), F.lit(0.3))
    return detections(spark, sf).filter("e_plx IS NOT NULL").select("id", F.round(xy, 7).alias("xy"), F.round(stats.binormal_logpdf(F.col("pmra") - 1, F.col("pmdec") + 1, xx, xy, yy), 4).alias("logpdf"))


@query("X25_combined_error", f"WITH {SQL_SEEN} SELECT id, round(greatest(sqrt(err * err + e_plx * e_plx), 0.01), 7) AS e FROM seen WHERE e_plx IS NOT NULL")
def x25(spark, sf):
    return detections(spark, sf).filter("e_plx IS NOT NULL").select("id", F.round(stats.combined_error(F.col("err"), F.col("e_plx")), 7).alias("e"))


@query("X26_labelled_bins", f"WITH {SQL_MEASURE} SELECT format('{{}}-{{}} kpc', CAST(floor(snr / 5) * 5 AS INTEGER), CAST(floor(snr / 5) * 5 + 5 AS INTEGER)) AS label, count(*) AS n FROM m GROUP BY 1")
def x26(spark, sf):
    a = (F.floor(F.col("snr") / 5) * 5).cast("int")
    return measurements(spark, sf).groupBy(F.format_string("%d-%d kpc", a, a + 5).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "M24_calibrated_velocities",
    f"WITH {SQL_MEASURE}, v AS (SELECT * FROM m WHERE rv IS NOT NULL AND err > 0), {SQL_FITS}, e AS (SELECT row_id, rv, err, rv - slope * err - intercept AS cal, sqrt(greatest(0, f * (sw * err * err - 2 * sx * err + sxx))) AS extra FROM v LEFT JOIN fit USING (survey)) SELECT row_id, round(CASE WHEN extra <= 5 THEN cal ELSE rv END, 4) AS rv_cal, round(CASE WHEN extra <= 5 THEN sqrt(err * err + extra * extra) ELSE err END, 4) AS err_cal, coalesce(extra <= 5, false) AS is_calibrated FROM e",
)
def m24(spark, sf):
    m = measurements(spark, sf).filter("rv IS NOT NULL AND err > 0")
    out = velocity.calibrated(m, velocity.binned_fit(m, ["survey"], "err", "rv", 1), "survey", "err")
    return out.select("row_id", F.round("rv_cal", 4).alias("rv_cal"), F.round("err_cal", 4).alias("err_cal"), "is_calibrated")


@query("M23_excluded_surveys", f"WITH {SQL_MEASURE} SELECT survey, count(*) AS n FROM m WHERE survey NOT IN ('AF', 'RF') GROUP BY survey")
def m23(spark, sf):
    return velocity.without_surveys(measurements(spark, sf), ["AF", "RF"]).groupBy("survey").agg(F.count(F.lit(1)).alias("n"))


@query("M26_normalised_errors", f"WITH {SQL_MEASURE}, f AS (SELECT survey, median(disc * 100 / err) AS factor FROM m WHERE err > 0 AND disc > 0 GROUP BY survey) SELECT row_id, round(err * coalesce(factor, 1), 6) AS err_norm FROM m LEFT JOIN f USING (survey)")
def m26(spark, sf):
    m = measurements(spark, sf)
    f = quantiles.medians(m.filter("err > 0 AND disc > 0").withColumn("ratio", F.col("disc") * 100 / F.col("err")), ["survey"], "ratio", "factor")
    return velocity.normalised_errors(m, f).select("row_id", F.round("err_norm", 6).alias("err_norm"))


_Z = "((id * 7919) % 2001 - 1000) / 400e0"


@query("M28_injection_recovery", f"WITH {SQL_SEEN}, o AS (SELECT plx, rv, plx + e_plx * {_Z} AS p, rv + err * {_Z} AS v, e_plx, err FROM seen WHERE plx IS NOT NULL AND e_plx IS NOT NULL), r AS (SELECT *, pow(p - 5, 2) / (4 + e_plx * e_plx) + pow(v - 20, 2) / (2500 + err * err) < 6 AS ok FROM o WHERE plx BETWEEN 0 AND 10 AND rv BETWEEN -200 AND 200) SELECT least(CAST(floor(plx / (10e0 / 14)) AS BIGINT), 13) AS bx, least(CAST(floor((rv + 200) / (400e0 / 14)) AS BIGINT), 13) AS by, count(*) AS n_injected, count(*) FILTER (ok) AS n_recovered, round(count(*) FILTER (ok) / count(*), 6) AS completeness FROM r GROUP BY 1, 2")
def m28(spark, sf):
    """Detections with their errors added again, by a fixed pattern, stand for injected stars; the selection of F5
    says which are recovered."""
    z = F.expr(_Z)
    d = detections(spark, sf).filter("plx IS NOT NULL AND e_plx IS NOT NULL").withColumns({"p": F.col("plx") + F.col("e_plx") * z, "v": F.col("rv") + F.col("err") * z})
    ok = F.pow(F.col("p") - 5, 2) / (4 + F.col("e_plx") * F.col("e_plx")) + F.pow(F.col("v") - 20, 2) / (2500 + F.col("err") * F.col("err")) < 6
    return binning.recovery_map(d.withColumn("ok", ok), "plx", "rv", "ok", (0, 10, 14), (-200, 200, 14)).withColumn("completeness", F.round("completeness", 6))


@query("Z1_density_curve", f"WITH {SQL_MEASURE}, b AS (SELECT avg(rv) AS v, count(*) AS n FROM m WHERE rv BETWEEN 0 AND 1000 GROUP BY least(floor(rv / (1000e0 / 512)), 511)), g AS (SELECT i * (1000e0 / 49) AS x FROM range(50) r(i)) SELECT round(x, 3) AS x, round(sum(n * exp(-0.5 * pow((x - v) / 40, 2))) / (sum(n) * 40 * sqrt(2 * pi())), 8) AS density FROM g, b GROUP BY x")
def z1(spark, sf):
    return binning.density_curve(measurements(spark, sf), "rv", 0, 1000, 50, 40.0).select(F.round("x", 3).alias("x"), F.round("density", 8).alias("density"))


@query("Z2_axis_range", f"WITH {SQL_MEASURE}, v AS (SELECT rv AS v FROM m WHERE rv > 0 UNION ALL SELECT err FROM m WHERE err > 0) SELECT round(least(quantile_cont(v, 0.01), 5), 5) AS lo, round(greatest(quantile_cont(v, 0.99), 5), 5) AS hi FROM v")
def z2(spark, sf):
    return binning.axis_range(measurements(spark, sf), ["rv", "err"], 5.0, True).select(F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


@query("Z3_typed_projection", f"WITH {SQL_SEEN} SELECT 'GC' AS kind, 1 / plx AS dist, rv, id FROM seen WHERE survey LIKE '1%' AND plx > 0 UNION ALL SELECT 'OC', plx, rv, id FROM seen WHERE survey LIKE '5%' AND plx < 300")
def z3(spark, sf):
    d = detections(spark, sf)
    gc = d.filter("survey LIKE '1%' AND plx > 0").select(F.lit("GC").alias("kind"), (1 / F.col("plx")).alias("dist"), "rv", "id")
    return gc.unionByName(d.filter("survey LIKE '5%' AND plx < 300").select(F.lit("OC").alias("kind"), F.col("plx").alias("dist"), "rv", "id"))


@query("Z4_reference_value", f"WITH {SQL_STAR} SELECT id, CASE WHEN id % 3 = 0 THEN mag ELSE plx END AS ref FROM star")
def z4(spark, sf):
    lit = F.when(F.col("id") % 3 == 0, F.concat(F.lit("+"), F.col("mag").cast("string"))).otherwise("-")
    return stars(spark, sf).select("id", F.coalesce(F.regexp_replace(lit, r"^\+", "").try_cast("double"), F.col("plx")).alias("ref"))


@query("Z6_cluster_distance", f"WITH {SQL_SEEN} SELECT star, round(avg(1 / plx), 6) AS kpc, round(stddev_pop(1 / plx), 6) AS spread FROM seen WHERE plx > 0 GROUP BY star")
def z6(spark, sf):
    return detections(spark, sf).filter("plx > 0").groupBy("star").agg(F.round(F.avg(1 / F.col("plx")), 6).alias("kpc"), F.round(F.stddev_pop(1 / F.col("plx")), 6).alias("spread"))


@query("Z7_velocity_reference", f"WITH {SQL_SEEN}, g AS (SELECT star, median(rv) AS med FROM seen GROUP BY star HAVING count(rv) >= 3) SELECT star, round(max(med), 5) AS median, round(median(abs(rv - med)), 5) AS mad FROM seen JOIN g USING (star) GROUP BY star")
def z7(spark, sf):
    return robust.median_mad(detections(spark, sf), ["star"], "rv").filter("n >= 3").select("star", F.round("median", 5).alias("median"), F.round("mad", 5).alias("mad"))


@query("Z8_member_else_master", f"WITH {SQL_SEEN} SELECT d.id, coalesce(d.plx, s.plx) AS plx, CASE WHEN d.plx IS NOT NULL THEN d.e_plx ELSE s.e_plx END AS e_plx FROM seen d JOIN star s ON s.id = d.star")
def z8(spark, sf):
    s = stars(spark, sf).select(F.col("id").alias("star"), F.col("plx").alias("s_plx"), F.col("e_plx").alias("s_e"))
    v, e = robust.first_known([(F.col("plx"), F.col("e_plx"), 1.0), (F.col("s_plx"), F.col("s_e"), 1.0)])
    return detections(spark, sf).join(s, "star").select("id", v.alias("plx"), e.alias("e_plx"))


@query("Z11_labelled_summaries", f"WITH {SQL_SEEN} SELECT survey, count(*) AS n, 'early' AS epoch FROM seen WHERE year(seen_at) < 1995 GROUP BY survey UNION ALL SELECT survey, count(*), 'late' FROM seen WHERE year(seen_at) >= 1995 GROUP BY survey")
def z11(spark, sf):
    d = detections(spark, sf)
    n = lambda df: df.groupBy("survey").agg(F.count(F.lit(1)).alias("n"))
    return sinks.summary({"early": n(d.filter("year(seen_at) < 1995")), "late": n(d.filter("year(seen_at) >= 1995"))}, "epoch", "n")


@query("M2_lognormal_with_errors")
def m2(spark, sf):
    x = measurements(spark, sf).withColumns({"x": F.col("err") / 20, "e": F.col("snr") / 200})
    m = mixture.fit_lognormal(x, "x", error="e")
    return spark.createDataFrame([(m.share, *m.core, *m.tail)], "share double, core_mu double, core_sigma double, tail_mu double, tail_sigma double")


@query("M3_separated_lognormal")
def m3(spark, sf):
    m = mixture.fit_lognormal(measurements(spark, sf).withColumn("x", F.col("err") / 20), "x", share_range=(0.4, 0.9), separation=0.8)
    return spark.createDataFrame([(m.share, *m.core, *m.tail)], "share double, core_mu double, core_sigma double, tail_mu double, tail_sigma double")


@query("M5_normal_mixture")
def m5(spark, sf):
    m = mixture.fit_normal(measurements(spark, sf).withColumn("x", F.col("snr")), "x")
    return spark.createDataFrame([(m.share, *m.core, *m.tail)], "share double, core_mu double, core_sigma double, tail_mu double, tail_sigma double")


@query("M11_hybrid_membership")
def m11(spark, sf):
    return members(spark, sf, "HYBRID")


@query("M12_stream_membership")
def m12(spark, sf):
    return members(spark, sf, "SGR")



def _sql_outlines() -> str:
    edges = [f"('{n}', {ax}e0, {ay}e0, {bx}e0, {by}e0)" for n, v in stats.POPULATIONS.items() for (ax, ay), (bx, by) in zip(v, [*v[1:], v[0]])]
    return ", ".join(edges)


@query("X28_population_outlines", f"WITH p AS (SELECT l_orderkey, row_number() OVER () AS k, l_quantity / 10e0 - 0.7e0 AS x, l_extendedprice % 22e0 - 6e0 AS y FROM lineitem), e AS (SELECT * FROM (VALUES {_sql_outlines()}) t(name, ax, ay, ux, uy)) SELECT name, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS ids FROM (SELECT name, l_orderkey, k FROM p JOIN e ON (ay > y) <> (uy > y) AND x < (y - ay) * (ux - ax) / (uy - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY name")
def x28(spark, sf):
    p = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") / 10 - 0.7).alias("x"), (F.col("l_extendedprice") % 22 - 6).alias("y"))
    named = p.select("l_orderkey", F.explode(stats.populations(F.col("x"), F.col("y"))).alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("ids"))


_MIRROR = "CASE WHEN ((({i} % {m}) + {m}) % {m}) < {n} THEN ((({i} % {m}) + {m}) % {m}) ELSE {m} - 1 - ((({i} % {m}) + {m}) % {m}) END"


@query("M29_contour_levels", f"""WITH {SQL_SEEN}, h AS (SELECT CAST(floor(ra / 10) AS BIGINT) AS bx, CAST(floor((dec + 90) / 10) AS BIGINT) AS by, count(*) AS v FROM seen WHERE ra >= 0 AND ra < 360 GROUP BY ALL),
  k AS (SELECT d, exp(-0.5 * pow(d / 2e0, 2)) / sum(exp(-0.5 * pow(d / 2e0, 2))) OVER () AS w FROM (SELECT unnest(range(-8, 9)) AS d)), g AS (SELECT x.bx, y.by FROM (SELECT unnest(range(36)) AS bx) x, (SELECT unnest(range(18)) AS by) y),
  a AS (SELECT g.bx, g.by, sum(w * coalesce(v, 0)) AS v FROM g CROSS JOIN k LEFT JOIN h ON h.by = g.by AND h.bx = {_MIRROR.format(i='(g.bx + d)', n=36, m=72)} GROUP BY ALL),
  b AS (SELECT g.bx, g.by, sum(w * coalesce(v, 0)) AS v FROM g CROSS JOIN k LEFT JOIN a ON a.bx = g.bx AND a.by = {_MIRROR.format(i='(g.by + d)', n=18, m=36)} GROUP BY ALL)
  SELECT round(quantile_cont(v, 0.2), 6) AS level_0, round(quantile_cont(v, 0.3875), 6) AS level_1, round(quantile_cont(v, 0.575), 6) AS level_2, round(quantile_cont(v, 0.7625), 6) AS level_3, round(quantile_cont(v, 0.95), 6) AS level_4 FROM b WHERE v > 0""")
def m29(spark, sf):
    d = detections(spark, sf).filter("ra >= 0 AND ra < 360").select(F.floor(F.col("ra") / 10).alias("bx"), F.floor((F.col("dec") + 90) / 10).alias("by"), F.lit(1.0).alias("v"))
    levels = binning.contour_levels(binning.smoothed_map(d, "v", 36, 18, 2.0), "v")
    return levels.select(*(F.round(c, 6).alias(c) for c in levels.columns))
