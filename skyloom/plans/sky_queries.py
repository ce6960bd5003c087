"""Queries of sky geometry, joins on the sphere and grouping."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import components, robust, sky_blocks, sky_join
from ..storage import stored
from .adapters import SQL_SEEN, SQL_STAR, detections, prefixed, stars

R = 0.05
SEP = "degrees(2 * asin(sqrt(least(1e0, pow(sin(radians({b}.dec - {a}.dec) / 2), 2) + cos(radians({a}.dec)) * cos(radians({b}.dec)) * pow(sin(radians({b}.ra - {a}.ra) / 2), 2)))))"
NEAR = f"near AS (SELECT d.id, s.id AS r_id, {SEP.format(a='d', b='s')} AS sep FROM seen d JOIN star s ON s.dec BETWEEN d.dec - 0.06 AND d.dec + 0.06 WHERE {SEP.format(a='d', b='s')} <= {R})"
PAIR = f"pair AS (SELECT a.id, b.id AS r_id, a.plx, a.e_plx, b.plx AS r_plx, b.e_plx AS r_e_plx, {SEP.format(a='a', b='b')} AS sep FROM seen a JOIN seen b ON a.id < b.id AND b.dec BETWEEN a.dec - 0.03 AND a.dec + 0.03 WHERE {SEP.format(a='a', b='b')} <= 0.025)"
AGREE = "(a.plx IS NULL OR r_plx IS NULL OR abs(a.plx - r_plx) <= greatest(3 * sqrt(pow(coalesce(a.e_plx, 0.5), 2) + pow(coalesce(r_e_plx, 0.5), 2)), 1))"
QUERIES: dict = {}


def query(name, sql=None):
    return lambda f: QUERIES.setdefault(name, (f, sql)) and f


def _star_side(spark, sf, *columns):
    return prefixed(stars(spark, sf).select("id", "ra", "dec", *columns))


@query("J1_nearest_within_radius", f"WITH {SQL_SEEN}, {NEAR}, best AS (SELECT id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM near GROUP BY id) SELECT seen.id, r_id, round(sep * 3600, 3) AS match_arcsec, r_id IS NOT NULL AS matched FROM seen LEFT JOIN best USING (id)")
def j1(spark, sf):
    out = sky_join.nearest(detections(spark, sf).select("id", "ra", "dec"), _star_side(spark, sf), R)
    return out.select("id", "r_id", F.round(F.col("sep") * 3600, 3).alias("match_arcsec"), "matched")


@query("J2_nearest_inner", f"WITH {SQL_SEEN}, {NEAR} SELECT id, arg_min(r_id, sep) AS r_id, round(min(sep) * 3600, 3) AS match_arcsec FROM near GROUP BY id")
def j2(spark, sf):
    out = sky_join.nearest(detections(spark, sf).select("id", "ra", "dec"), _star_side(spark, sf), R, "inner")
    return out.select("id", "r_id", F.round(F.col("sep") * 3600, 3).alias("match_arcsec"))


@query(
    "J3_first_match_update",
    f"""WITH {SQL_SEEN}, {NEAR}, hit AS (SELECT id, arg_min(r_id, sep) AS base FROM near GROUP BY id), taken AS (SELECT base, min(id) AS other FROM hit GROUP BY base)
SELECT s.id, round(d.rv, 4) AS rv, false AS appended FROM star s LEFT JOIN taken ON base = s.id LEFT JOIN seen d ON d.id = other
UNION ALL SELECT id, round(rv, 4), true FROM seen WHERE id NOT IN (SELECT id FROM hit) AND rv IS NOT NULL""",
)
def j3(spark, sf):
    base = stars(spark, sf).select("id", "ra", "dec", F.lit(None).cast("double").alias("rv"))
    out = sky_join.first_match_update(base, prefixed(detections(spark, sf).select("id", "ra", "dec", "rv")), R, ["rv"])
    return out.select("id", F.round("rv", 4).alias("rv"), "appended")


@query("J4_radius_self_pairs", f"WITH {SQL_SEEN}, {PAIR} SELECT id, r_id, round(sep * 3600, 3) AS sep_arcsec FROM pair a WHERE {AGREE}")
def j4(spark, sf):
    pairs = sky_blocks.pairs(detections(spark, sf).select("id", "ra", "dec", "plx", "e_plx"), 0.025, sky.parallax_near, ["plx", "e_plx"])
    return pairs.select("id", "r_id", F.round(F.col("sep") * 3600, 3).alias("sep_arcsec"))


@query(
    "J5_candidates_then_nearest",
    f"""WITH {SQL_SEEN}, {NEAR}, of AS (SELECT n.id, arg_min(n.r_id, n.sep) AS r_id, bool_or(abs(d.plx - s.plx) <= greatest(3 * sqrt(pow(coalesce(d.e_plx, 0.5), 2) + pow(s.e_plx, 2)), 0.1) OR d.plx IS NULL) AS ok
FROM near n JOIN seen d ON d.id = n.id JOIN star s ON s.id = n.r_id GROUP BY n.id) SELECT seen.id, of.r_id FROM seen LEFT JOIN of ON of.id = seen.id AND ok""",
)
def j5(spark, sf):
    d = detections(spark, sf).select("id", "ra", "dec", "plx", "e_plx")
    accept = functools.partial(sky.parallax_near, floor=0.1)
    return sky_join.nearest_accepted(d, _star_side(spark, sf, "plx", "e_plx"), R, accept, ["plx", "e_plx"]).select("id", "r_id")


@query("J6_cone_search", f"WITH {SQL_SEEN} SELECT c.id AS centre, count(*) AS n, round(min({SEP.format(a='c', b='d')}), 6) AS nearest_deg FROM star c JOIN seen d ON abs(c.dec - d.dec) <= 1.51 WHERE {SEP.format(a='c', b='d')} <= 0.5 + (c.id % 3) / 2e0 GROUP BY c.id")
def j6(spark, sf):
    centres = stars(spark, sf).select("id", "ra", "dec", (0.5 + F.col("id") % 3 / 2).alias("reach"))
    seen = stored(prefixed(detections(spark, sf).select("id", "ra", "dec")), "seen")
    n = sky_blocks.counts(centres, seen, [F.col("reach")])
    # whatever is within a centre's reach has the nearest of all within the largest
    near = sky_blocks.nearest(centres, seen, 1.5).select("id", "sep")
    return n.join(near, "id").select(F.col("id").alias("centre"), F.col("n0").alias("n"), F.round("sep", 6).alias("nearest_deg"))


@query(
    "J9_combined_metric_nearest",
    f"""WITH {SQL_SEEN}, near AS (SELECT d.id, s.id AS r_id, sqrt(pow({SEP.format(a='d', b='s')} / 0.1, 2) + (pow(d.pmra - s.pmra, 2) + pow(d.pmdec - s.pmdec, 2)) / 0.01) AS metric FROM seen d JOIN star s ON abs(s.dec - d.dec) <= 0.11 WHERE {SEP.format(a='d', b='s')} <= 0.1),
best AS (SELECT id, arg_min(r_id, metric) AS r_id, min(metric) AS metric FROM near WHERE metric <= 1 GROUP BY id) SELECT seen.id, r_id, round(metric, 6) AS metric FROM seen LEFT JOIN best USING (id)""",
)
def j9(spark, sf):
    d = detections(spark, sf).select("id", "ra", "dec", "pmra", "pmdec")
    return sky_join.nearest_combined(d, _star_side(spark, sf, "pmra", "pmdec"), 0.1, 0.1).select("id", "r_id", F.round("metric", 6).alias("metric"))


@query(
    "M1_connected_components",
    f"""WITH RECURSIVE {SQL_SEEN}, {PAIR}, edge AS (SELECT id AS a, r_id AS b FROM pair UNION SELECT r_id, id FROM pair), reach AS (SELECT id AS node, id AS other FROM seen UNION SELECT node, b FROM reach JOIN edge ON a = other)
SELECT node AS id, min(other) AS group_id FROM reach GROUP BY node""",
)
def m1(spark, sf):
    d = stored(detections(spark, sf).select("id", "ra", "dec"), "seen")
    return components.groups(d.select("id"), sky_blocks.pairs(d, 0.025, links=True))


@query(
    "P2_catalogue_fusion",
    f"""WITH RECURSIVE {SQL_SEEN}, {PAIR}, edge AS (SELECT id AS a, r_id AS b FROM pair a WHERE {AGREE} UNION SELECT r_id, id FROM pair a WHERE {AGREE}), reach AS (SELECT id AS node, id AS other FROM seen UNION SELECT node, b FROM reach JOIN edge ON a = other),
g AS (SELECT node AS id, min(other) AS group_id FROM reach GROUP BY node), v AS (SELECT group_id, rv, err, ra, dec, survey FROM seen JOIN g USING (id)),
one AS (SELECT group_id, count(*) AS n, sum(rv / (err * err)) / sum(1 / (err * err)) AS wm, avg(rv) AS av, stddev_pop(rv) AS sd, avg(ra) AS ra, avg(dec) AS dec, string_agg(DISTINCT survey, ',' ORDER BY survey) AS surveys FROM v GROUP BY group_id),
two AS (SELECT group_id, count(*) FILTER (abs(rv - wm) <= 3 * err) AS inside, sum(rv / (err * err)) FILTER (abs(rv - wm) <= 3 * err) / sum(1 / (err * err)) FILTER (abs(rv - wm) <= 3 * err) AS m, 1 / sqrt(sum(1 / (err * err)) FILTER (abs(rv - wm) <= 3 * err)) AS e FROM v JOIN one USING (group_id) GROUP BY group_id)
SELECT group_id, n, round(ra, 4) AS ra, round(dec, 4) AS dec, round(CASE WHEN inside > 0 THEN m ELSE av END, 4) AS rv, round(CASE WHEN inside > 0 THEN e ELSE sd END, 4) AS rv_err, CASE WHEN inside > 0 THEN n - inside ELSE 0 END AS n_outliers, surveys FROM one JOIN two USING (group_id)""",
)
def p2(spark, sf):
    """Pairs within a radius that agree in parallax, their components, and one merged row for each."""
    d = stored(detections(spark, sf), "seen")
    links = sky_blocks.pairs(d.select("id", "ra", "dec", "plx", "e_plx"), 0.025, sky.parallax_near, ["plx", "e_plx"], links=True)
    g = components.groups(d, links)
    merged = robust.clipped_weighted_mean(g, ["group_id"], "rv", "err")
    place = g.groupBy("group_id").agg(F.round(F.avg("ra"), 4).alias("ra"), F.round(F.avg("dec"), 4).alias("dec"), robust.joined_text(F.col("survey")).alias("surveys"))
    return place.join(merged, "group_id").select("group_id", "n", "ra", "dec", F.round("mean", 4).alias("rv"), F.round("err", 4).alias("rv_err"), "n_outliers", "surveys")


@query("X1_unit_vectors", f"WITH {SQL_STAR} SELECT id, round(cos(radians(dec)) * cos(radians(ra)), 8) AS x, round(cos(radians(dec)) * sin(radians(ra)), 8) AS y, round(sin(radians(dec)), 8) AS z FROM star")
def x1(spark, sf):
    x, y, z = sky.unit_vector(F.col("ra"), F.col("dec"))
    return stars(spark, sf).select("id", F.round(x, 8).alias("x"), F.round(y, 8).alias("y"), F.round(z, 8).alias("z"))


@query("X2_angle_and_chord", f"WITH {SQL_STAR} SELECT id, round(2 * sin(radians(plx) / 2), 9) AS chord, round(plx * 3600, 4) AS back_arcsec FROM star")
def x2(spark, sf):
    c = sky.chord_of_angle(F.col("plx"))
    return stars(spark, sf).select("id", F.round(c, 9).alias("chord"), F.round(sky.angle_of_chord(c) * 3600, 4).alias("back_arcsec"))


@query("X3_haversine", f"WITH {SQL_STAR} SELECT a.id, round({SEP.format(a='a', b='b')}, 7) AS sep FROM star a JOIN star b ON b.id = a.id + 1")
def x3(spark, sf):
    a = stars(spark, sf)
    b = prefixed(a.select((F.col("id") - 1).alias("id"), "ra", "dec"))
    return a.join(b, F.col("id") == F.col("r_id")).select("id", F.round(sky.separation(F.col("ra"), F.col("dec"), F.col("r_ra"), F.col("r_dec")), 7).alias("sep"))


@query(
    "X4_tangent_plane",
    f"""WITH {SQL_SEEN}, p AS (SELECT d.id, radians(d.ra - s.ra) AS a, radians(d.dec) AS d, radians(s.dec) AS d0 FROM seen d JOIN star s ON s.id = d.star),
q AS (SELECT id, degrees(cos(d) * sin(a) / (sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a))) AS xi, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a)) / (sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a))) AS eta FROM p)
SELECT id, round(xi, 7) AS xi, round(eta, 7) AS eta, round(sqrt(pow(xi * sin(radians(30)) + eta * cos(radians(30)), 2) + pow((xi * cos(radians(30)) - eta * sin(radians(30))) / 0.6, 2)), 6) AS r FROM q""",
)
def x4(spark, sf):
    d = detections(spark, sf).join(stars(spark, sf).select(F.col("id").alias("star"), F.col("ra").alias("ra0"), F.col("dec").alias("dec0")), "star")
    xi, eta = sky.tangent_plane(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    return d.select("id", F.round(xi, 7).alias("xi"), F.round(eta, 7).alias("eta"), F.round(sky.elliptical_radius(xi, eta, F.lit(0.4), F.lit(30.0)), 6).alias("r"))


_G = " , ".join(f"({a}e0) * cos(radians(dec)) * cos(radians(ra)) + ({b}e0) * cos(radians(dec)) * sin(radians(ra)) + ({c}e0) * sin(radians(dec)) AS g{k}" for k, (a, b, c) in zip("xyz", sky.GALACTIC))
_GAL = f"g AS (SELECT id, plx, {_G} FROM star), lb AS (SELECT id, 1 / plx AS d, (degrees(atan2(gy, gx)) + 360) % 360 AS l, degrees(asin(least(1, greatest(-1, gz)))) AS b FROM g)"


@query("X5_galactic_coordinates", f"WITH {SQL_STAR}, {_GAL} SELECT id, round(l, 6) AS l, round(b, 6) AS b FROM lb")
def x5(spark, sf):
    l, b = sky.galactic(F.col("ra"), F.col("dec"))
    return stars(spark, sf).select("id", F.round(l, 6).alias("l"), F.round(b, 6).alias("b"))


@query("X6_galactocentric_radius", f"WITH {SQL_STAR}, {_GAL} SELECT id, round(sqrt(pow(d * cos(radians(b)) * cos(radians(l)) - 8.2, 2) + pow(d * cos(radians(b)) * sin(radians(l)), 2) + pow(d * sin(radians(b)), 2)), 6) AS r_kpc FROM lb")
def x6(spark, sf):
    l, b = sky.galactic(F.col("ra"), F.col("dec"))
    return stars(spark, sf).select("id", F.round(sky.galactocentric_radius(l, b, sky.parallax_distance(F.col("plx"))), 6).alias("r_kpc"))


@query("X7_sky_pixels", f"WITH {SQL_STAR} SELECT CAST(CAST(floor(ra) AS BIGINT) % 360 * 180 + CAST(floor(dec + 90) AS BIGINT) % 180 AS BIGINT) AS pixel, count(*) AS n FROM star GROUP BY 1")
def x7(spark, sf):
    return stars(spark, sf).groupBy(sky.degree_pixel(F.col("ra"), F.col("dec")).alias("pixel")).agg(F.count(F.lit(1)).alias("n"))


_RING = """a AS (SELECT mag, sin(radians(dec)) AS z, (ra % 360) / 90 AS t FROM star), b AS (SELECT *, CAST(floor(32 * (0.5 + t) - 32 * z * 0.75) AS BIGINT) AS up, CAST(floor(32 * (0.5 + t) + 32 * z * 0.75) AS BIGINT) AS down, t - floor(t) AS tp, 32 * sqrt(3 * (1 - abs(z))) AS tmp FROM a),
c AS (SELECT *, 33 + up - down AS ring, CAST(floor(tp * tmp) AS BIGINT) + CAST(floor((1 - tp) * tmp) AS BIGINT) + 1 AS r FROM b),
d AS (SELECT mag, CASE WHEN abs(z) <= 2/3e0 THEN 2 * 32 * 31 + (ring - 1) * 128 + (CAST(floor((up + down - 32 + ((ring + 1) % 2) + 1) / 2) AS BIGINT) % 128 + 128) % 128
WHEN z > 0 THEN 2 * r * (r - 1) + CAST(floor(t * r) AS BIGINT) % (4 * r) ELSE 12 * 32 * 32 - 2 * r * (r + 1) + CAST(floor(t * r) AS BIGINT) % (4 * r) END AS pixel FROM c)"""


@query("X7_healpix_counts", f"WITH {SQL_STAR}, {_RING} SELECT CAST(pixel AS BIGINT) AS pixel, count(*) AS n, round(avg(mag), 4) AS mean_mag FROM d GROUP BY pixel")
def x7h(spark, sf):
    return stars(spark, sf).groupBy(sky.healpix_ring(F.col("ra"), F.col("dec"), 32).alias("pixel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mag"), 4).alias("mean_mag"))


_NESTED = """a AS (SELECT mag, sin(radians(dec)) AS z, (ra % 360) / 90 AS t FROM star), b AS (SELECT *, CAST(floor(32 * (0.5 + t) - 24 * z) AS BIGINT) AS down, CAST(floor(32 * (0.5 + t) + 24 * z) AS BIGINT) AS up, CAST(least(floor(t), 3) AS BIGINT) AS q, 32 * sqrt(3 * (1 - abs(z))) AS reach FROM a),
c AS (SELECT *, CAST(least(floor((t - q) * reach), 31) AS BIGINT) AS p, CAST(least(floor((1 - t + q) * reach), 31) AS BIGINT) AS m, down // 32 AS fd, up // 32 AS fu FROM b),
d AS (SELECT mag, CASE WHEN abs(z) > 2/3e0 THEN CASE WHEN z > 0 THEN q ELSE q + 8 END WHEN fd = fu THEN CASE WHEN fd < 4 THEN fd + 4 ELSE fd END WHEN fd < fu THEN fd ELSE fu + 8 END AS face,
CASE WHEN abs(z) <= 2/3e0 THEN up % 32 WHEN z > 0 THEN 31 - m ELSE p END AS x, CASE WHEN abs(z) <= 2/3e0 THEN 31 - down % 32 WHEN z > 0 THEN 31 - p ELSE m END AS y FROM c),
e AS (SELECT mag, face * 1024 + list_sum([((x >> i) & 1) * (1 << (2 * i)) + ((y >> i) & 1) * (2 << (2 * i)) for i in range(5)]) AS pixel FROM d)"""


@query("X7_healpix_nested", f"WITH {SQL_STAR}, {_NESTED} SELECT CAST(pixel AS BIGINT) AS pixel, count(*) AS n, round(avg(mag), 4) AS mean_mag FROM e GROUP BY pixel")
def x7n(spark, sf):
    return stars(spark, sf).groupBy(sky.healpix_nested(F.col("ra"), F.col("dec"), 32).alias("pixel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mag"), 4).alias("mean_mag"))


@query(
    "X8_space_motion",
    f"""WITH {SQL_SEEN}, s AS (SELECT id, ra, dec, pmra, pmdec, 1 + coalesce(CASE WHEN plx > 0 THEN rv * plx END, 0) * 1.0227121650537077e-9 * -15.5 AS g, radians(pmra / 3.6e6) * -15.5 AS a, radians(pmdec / 3.6e6) * -15.5 AS d FROM seen),
v AS (SELECT *, g * cos(radians(dec)) * cos(radians(ra)) - a * sin(radians(ra)) - d * sin(radians(dec)) * cos(radians(ra)) AS x, g * cos(radians(dec)) * sin(radians(ra)) + a * cos(radians(ra)) - d * sin(radians(dec)) * sin(radians(ra)) AS y, g * sin(radians(dec)) + d * cos(radians(dec)) AS z FROM s)
SELECT id, round(coalesce((degrees(atan2(y, x)) + 360) % 360, ra), 8) AS ra, round(coalesce(degrees(atan2(z, sqrt(x * x + y * y))), dec), 8) AS dec FROM v""",
)
def x8m(spark, sf):
    ra, dec = sky.space_motion(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.lit(-15.5), F.col("rv"), sky.parallax_distance(F.col("plx")))
    return detections(spark, sf).select("id", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@query("X8_epoch_propagation", f"WITH {SQL_STAR} SELECT id, round(ra + pmra * -15.5 / (cos(radians(dec)) * 3.6e6), 8) AS ra, round(dec + pmdec * -15.5 / 3.6e6, 8) AS dec FROM star")
def x8(spark, sf):
    ra, dec = sky.propagate(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.lit(-15.5))
    return stars(spark, sf).select("id", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@query("X9_distances", f"WITH {SQL_STAR} SELECT id, round(1 / plx, 8) AS kpc, round(5 * log10(greatest(1 / plx, 0.01) * 1000) - 5, 8) AS modulus FROM star")
def x9(spark, sf):
    d = sky.parallax_distance(F.col("plx"))
    return stars(spark, sf).select("id", F.round(d, 8).alias("kpc"), F.round(sky.distance_modulus(d), 8).alias("modulus"))


@query("X10_better_distance", f"WITH {SQL_SEEN} SELECT id, round(CASE WHEN plx IS NULL OR e_plx IS NULL OR plx <= 0 OR err / (abs(rv) + 1) <= abs(e_plx / plx) THEN abs(rv) + 1 ELSE 1 / plx END, 8) AS d FROM seen")
def x10(spark, sf):
    d = F.abs("rv") + 1
    return detections(spark, sf).select("id", F.round(sky.better_distance(d, F.col("err"), F.col("plx"), F.col("e_plx")), 8).alias("d"))


@query("X12_parallax_consistency", f"WITH {SQL_SEEN} SELECT a.id, coalesce(a.plx IS NULL OR b.plx IS NULL OR abs(a.plx - b.plx) <= 3 * sqrt(pow(coalesce(a.e_plx, 0.1 * abs(a.plx)), 2) + pow(coalesce(b.e_plx, 0.1 * abs(b.plx)), 2)) OR abs(a.plx - b.plx) / nullif(greatest(abs(a.plx), abs(b.plx)), 0) < 0.2, false) AS agree FROM seen a JOIN seen b ON b.id = a.id + 1")
def x12(spark, sf):
    d = detections(spark, sf).select("id", F.array(F.struct(F.col("plx").alias("value"), F.col("e_plx").alias("error"))).alias("p"))
    other = d.select((F.col("id") - 1).alias("id"), F.col("p").alias("q"))
    return d.join(other, "id").select("id", sky.parallaxes_agree(F.col("p"), F.col("q")).alias("agree"))


@query("A33_annulus_density", f"WITH {SQL_SEEN} SELECT c.id AS centre, round(count(*) / (pi() * (2.25 - 0.25)), 8) AS density FROM star c JOIN seen d ON abs(c.dec - d.dec) <= 1.51 WHERE {SEP.format(a='c', b='d')} <= 1.5 AND {SEP.format(a='c', b='d')} > 0.5 GROUP BY c.id")
def a33(spark, sf):
    centres = stars(spark, sf).select("id", "ra", "dec")
    n = sky_blocks.counts(centres, prefixed(detections(spark, sf).select("id", "ra", "dec")), [F.lit(0.5), F.lit(1.5)])
    ring = n.select("id", (F.col("n1") - F.col("n0")).alias("n")).filter("n > 0")
    return ring.select(F.col("id").alias("centre"), F.round(F.col("n") / (F.pi() * 2.0), 8).alias("density"))


@query("A33_annulus_density_all", f"WITH {SQL_SEEN}, k AS (SELECT * FROM (VALUES (0, 0e0, 0.5e0), (1, 0.5e0, 1e0), (2, 1e0, 1.5e0)) t(ring, lo, hi)), p AS (SELECT c.id, {SEP.format(a='c', b='d')} AS sep FROM star c JOIN seen d ON abs(c.dec - d.dec) <= 1.51) SELECT c.id AS centre, k.ring, count(p.id) AS n, round(count(p.id) / (pi() * (hi * hi - lo * lo)), 8) AS density FROM star c CROSS JOIN k LEFT JOIN p ON p.id = c.id AND p.sep > lo AND p.sep <= hi GROUP BY c.id, k.ring, lo, hi")
def a33_all(spark, sf):
    """Three rings about every star, empty ones too."""
    centres = stars(spark, sf).select("id", "ra", "dec")
    within = sky_blocks.counts(centres, prefixed(detections(spark, sf).select("id", "ra", "dec")), [F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(1.5)])
    n = within.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("ring"), (F.col(f"n{k + 1}") - F.col(f"n{k}")).alias("n")) for k in range(3)))))
    rings = centres.select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ring"))
    area = F.pi() * (F.pow((F.col("ring") + 1) * 0.5, 2) - F.pow(F.col("ring") * 0.5, 2))
    out = rings.join(n, ["id", "ring"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(F.col("id").alias("centre"), "ring", "n", F.round(F.col("n") / area, 8).alias("density"))
