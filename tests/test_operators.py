"""Operators on small tables with edge rows, against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky, stats, text
from skyloom.operators import binning, components, keyed_join, membership, mixture, robust, sky_join, velocity
from skyloom.operators.density import density_labels
from skyloom.sources import columns, fits, sinks
from skyloom.sources import text as readers
from skyloom.streaming import histogram as growing


def sep(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


@pytest.mark.parametrize("radius", [0.3, 4.0])
def test_sky_join_at_poles_and_seam(spark, radius):
    rng = np.random.default_rng(2)
    ra = np.r_[0.0, 359.9999, 359.95, 0.05, rng.uniform(0, 360, 150), rng.uniform(0, 360, 60), rng.uniform(0, 360, 60), [10.0, None][0]]
    dec = np.r_[0.0, 0.0, 10.0, 10.0, np.degrees(np.arcsin(rng.uniform(-1, 1, 150))), rng.uniform(88, 90, 60), rng.uniform(-90, -88, 60), 90.0]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(ra)), "ra": ra, "dec": dec}))
    more = df.union(spark.createDataFrame([(9000, None, 1.0), (9001, float("nan"), 1.0)], "id long, ra double, dec double"))
    got = {(r.id, r.r_id) for r in sky_join.self_pairs(more, radius).collect()}
    d = sep(ra[:, None], dec[:, None], ra[None], dec[None])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius)) if i < j}
    assert got == want and (0, 1) in want


def test_nearest_keeps_unmatched_and_breaks_ties(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0), (2, 200.0, 0.0), (3, None, None)], "id long, ra double, dec double")
    right = spark.createDataFrame([(7, 10.0, 0.5), (5, 10.0, -0.5), (6, 10.0, 0.9)], "r_id long, r_ra double, r_dec double")
    assert {r.id: r.r_id for r in sky_join.nearest(left, right, 1.0).collect()} == {1: 5, 2: None, 3: None}


def test_components_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (3, 3), (1, 2)], "a long, b long")
    got = {r.id: r.group_id for r in components.groups(spark.range(1, 9), edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}


def test_clipped_means_edge_groups(spark):
    rows = [("one", 5.0, 1.0), ("noerr", 1.0, None), ("noerr", 3.0, None), ("zero", 2.0, 0.0), *[("out", v, 1.0) for v in [1.0] * 10 + [1.1] * 10 + [9.0]], ("all", 0.0, 0.1), ("all", 10.0, 0.1), ("none", None, 1.0)]
    got = {r.k: r for r in robust.clipped_weighted_mean(spark.createDataFrame(rows, "k string, v double, e double"), ["k"], "v", "e").collect()}
    assert got["one"].mean == 5 and got["one"].err == 1 and got["noerr"].mean == 2 and got["noerr"].err is None and "none" not in got
    assert got["out"].outliers == [9.0] and got["out"].mean == pytest.approx(1.05)
    assert got["all"].mean == 5 and got["all"].err == 5 and got["all"].n_outliers == 0 and got["zero"].mean == 2
    mad = {r.k: r for r in robust.mad_clipped_mean(spark.createDataFrame([("same", 1.0), ("same", 1.0), ("same", 9.0), *[("x", float(v)) for v in (1, 2, 3, 2, 50)]], "k string, v double"), ["k"], "v").collect()}
    assert mad["same"].mean == pytest.approx(11 / 3) and mad["x"].mean == 2 and mad["x"].n_outliers == 1


def test_healpix(spark):
    # all pixels of a fine grid are in range, equally large, and pole pixels are the first and last four
    g = spark.range(200_000).select((F.col("id") * 137.50776405 % 360).alias("ra"), F.degrees(F.asin(2 * ((F.col("id") + 0.5) / 200_000) - 1)).alias("dec"))
    n = g.groupBy(sky.healpix_ring(F.col("ra"), F.col("dec"), 8).alias("p")).count().toPandas()
    assert n.p.min() == 0 and n.p.max() == 767 and len(n) == 768 and n["count"].between(230, 290).all()
    one = spark.range(1).select(sky.healpix_ring(F.lit(45.0), F.lit(90.0), 4).alias("a"), sky.healpix_ring(F.lit(0.0), F.lit(0.0), 1).alias("b"), sky.healpix_ring(F.lit(45.0), F.lit(-90.0), 4).alias("c")).first()
    assert one.a == 0 and one.b == 4 and one.c == 188


def test_text_functions(spark):
    df = spark.createDataFrame([("NGC_5139 oCen", "-00 30 00", "x gdr3_source_id:1234567890123456789;", "1.50000")], "n string, d string, i string, f string")
    r = df.select(text.plain_name(F.col("n")).alias("n"), text.sexagesimal(F.col("d")).alias("d"), text.extract_id(F.col("i"), "gdr3_source_id").alias("i"), text.short_float_text(F.col("f").cast("double")).alias("f"), text.given_text(F.lit(" NaN ")).alias("g"), text.resolve(F.lit("d125_x")).alias("s")).first()
    assert (r.n, r.d, r.i, r.f, r.g, r.s) == ("ngc5139ocen", -0.5, 1234567890123456789, "1.5", None, "GAIA")


def test_bins_at_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,), (5.0,), (-1.0,)], "x double")
    r = df.select("x", stats.bin_half_open(F.col("x"), 0, 10, 10).alias("h"), stats.bin_last_closed(F.col("x"), 0, 10, 10).alias("c"), stats.bin_open_low(F.col("x"), 0, 10, 10).alias("o")).collect()
    assert {x.x: (x.h, x.c, x.o) for x in r} == {0.0: (0, 0, 0), 1.0: (1, 1, 0), 10.0: (None, 9, 9), None: (None, None, 0), 5.0: (5, 5, 4), -1.0: (None, None, 0)}


def test_precision_recall_of_nothing(spark):
    out = binning.precision_recall(spark.createDataFrame([(0.5,)], "p double"), "p", 3).orderBy("k").collect()
    assert [(r.precision, r.recall) for r in out] == [(0.5, 1.0), (0.5, 1.0), (1.0, 0.0)]


def test_mixtures_find_their_parameters(spark):
    rng = np.random.default_rng(4)
    x = np.r_[np.exp(rng.normal(-1, 0.3, 7000)), np.exp(rng.normal(1, 0.5, 3000))]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    m = mixture.fit_lognormal(df, "x", 0, 50)
    assert abs(m.core[0] + 1) < 0.05 and abs(m.tail[0] - 1) < 0.1 and abs(m.share - 0.7) < 0.03
    p = df.withColumn("p", m.purity(F.col("x"))).agg(F.avg("p")).first()[0]
    assert abs(p - m.share) < 0.02
    g = mixture.fit_gamma(spark.createDataFrame(pd.DataFrame({"x": np.r_[rng.gamma(4, 0.1, 6000), rng.gamma(9, 0.4, 4000)]})), "x", 0, 20)
    assert g.core[0] / g.core[1] == pytest.approx(0.4, rel=0.1) and g.tail[0] / g.tail[1] == pytest.approx(3.6, rel=0.1)
    n = mixture.fit_normal(spark.createDataFrame(pd.DataFrame({"x": np.r_[rng.normal(10, 1, 7000), rng.normal(12, 4, 3000)]})), "x")
    assert n.core[1] == pytest.approx(1, rel=0.15) and n.tail[1] > 3
    assert mixture.fit_gamma(df.limit(20), "x") is None
    assert mixture.digamma(1.0) == pytest.approx(-0.5772156649, rel=1e-7) and mixture.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-6)


def field(rng, n=400, members=150):
    pm = np.r_[rng.normal(0, 0.2, (members, 2)) + [3, -2], rng.normal(0, 4, (n, 2))]
    r = np.r_[np.abs(rng.normal(0, 0.05, members)), rng.uniform(0, 0.6, n)]
    return pd.DataFrame({"object": "a", "id": np.arange(n + members), "pmra": pm[:, 0], "pmdec": pm[:, 1], "e_pmra": 0.05, "e_pmdec": 0.05, "rho": 0.0, "radius": r, "rhalf": 0.1, "limit": 0.6, "rv": np.r_[rng.normal(50, 5, members), rng.normal(0, 80, n)], "e_rv": 2.0})


@pytest.mark.parametrize("method", ["GC", "OC", "GMM", "HYBRID", "SGR"])
def test_members_are_found(spark, method):
    pdf = field(np.random.default_rng(8), 60 if method in ("OC", "SGR") else 400)
    p = membership.membership(spark.createDataFrame(pdf), method).toPandas().sort_values("id").p_member.to_numpy()
    assert p[:150].mean() > 0.6 and p[:150].mean() > 2 * p[150:].mean()
    small = membership.membership(spark.createDataFrame(pdf.head(3)), method).toPandas()
    assert len(small) == 3


def test_ks_and_dbscan(spark):
    rng = np.random.default_rng(1)
    # a reference has to be positive, so both samples and their normal stand ten further on
    samples = pd.concat([pd.DataFrame({"object": name, "p_member": 0.9, "v": 10 + rng.normal(mean, 1, 500), "ref": 10.0, "ref_err": 1.0}) for name, mean in (("same", 0), ("shifted", 1))])
    p = {r.object: r.ks_p for r in membership.quality_flags(spark.createDataFrame(samples), "v", "ref", "ref_err").collect()}
    assert p["same"] > 0.01 and p["shifted"] < 1e-6
    pts = np.r_[rng.normal(0, 0.1, (50, 2)), rng.normal(5, 0.1, (50, 2)), [[20, 20]]]
    rows = spark.createDataFrame(pd.DataFrame({"g": "a", "id": np.arange(101), "x": pts[:, 0], "y": pts[:, 1]}))
    label = {r.id: r.label for r in density_labels(rows, "g", 0.3, 5).collect()}
    assert {label[k] for k in range(50)} == {0} and {label[k] for k in range(50, 100)} == {50} and label[100] is None


def test_three_cornered_hat_recovers_errors(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(0, 50, 4000)
    rows = pd.concat([pd.DataFrame({"survey": s, "star": np.arange(4000), "rv": true + rng.normal(0, e, 4000), "err": 1.0}) for s, e in (("A", 1.0), ("B", 2.0), ("C", 4.0))])
    means = velocity.survey_means(spark.createDataFrame(rows))
    got = {r.survey: r.factor for r in velocity.three_cornered(velocity.zero_points(means), means).collect()}
    assert got["A"] == pytest.approx(1, abs=0.5) and got["B"] == pytest.approx(2, rel=0.15) and got["C"] == pytest.approx(4, rel=0.1)


def test_fits_and_normal_equations(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, 5000)
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "x": x, "y": 2 * x + 1 + rng.normal(0, 0.1, 5000), "e": 0.1}))
    fit = velocity.binned_fit(df, ["s"], "x", "y", 1)
    assert fit[("a",)][0] == pytest.approx([2, 1 - fit[("a",)][3]], abs=0.05)  # the median is taken off first
    assert velocity.pooled(fit)[0] == pytest.approx(fit[("a",)][0])
    assert velocity.normal_equations(df, ["x"], "y", "e")[0] == pytest.approx([1, 2], abs=0.02)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Galaxy, RA ,DEC,v,verr\nX,10.5,-1,-999,2\nY,11,2,35.5,-999\n")
    got = readers.dwarf_catalogue(spark, str(tmp_path / "a.csv")).collect()
    assert len(got) == 1 and got[0].v == 35.5 and got[0].verr is None
    (tmp_path / "b.txt").write_text("  7  1.5 abc\n\n 8 x\n")
    assert [tuple(r) for r in readers.blank_separated(spark, str(tmp_path / "b.txt"), {"id": (0, "long"), "g": (1, "double"), "t": (2, "string")}).collect()] == [(7, 1.5, "abc"), (8, None, None)]
    (tmp_path / "c.dat").write_text("AB  12 30 00 -01 30 00 5.5\nshort\n")
    r = readers.literature(spark, str(tmp_path / "c.dat"), {"n": (0, 3), "ra": (4, 12), "dec": (13, 22), "v": (23, 26)}, "ra", "dec", True, 20).collect()
    assert len(r) == 1 and r[0].ra == 187.5 and r[0].dec == -1.5 and r[0].v == 5.5
    for n, t in (("m1.tsv", "source_id\tpm\n123\t1\n"), ("m2.tsv", "other\n5\n"), ("m3.tsv", "source_id\tx\n9\t2\n")):
        (tmp_path / n).write_text(t)
    t = readers.tsv_folder(spark, [str(tmp_path / n) for n in ("m1.tsv", "m2.tsv", "m3.tsv")], "source_id")
    assert {(r.source_id, r.pm, r.x) for r in t.collect()} == {("123", 1, None), ("9", None, 2)}
    assert columns.paired(["plx_1", "plx_err_1", "plx_2", "plx_err_2"], "plx", "err") == [("plx_1", "plx_err_1"), ("plx_2", "plx_err_2")]
    assert columns.preflight(spark.range(5), ["id", "x"])["missing"] == ["x"]


def test_fits_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.fits")
    fits.write(path, {"id": np.arange(10, dtype="i8") + 10**18, "x": np.linspace(0, 1, 10), "name": np.array([f"s{i}" for i in range(10)], "S4"), "ok": np.arange(10) % 2 == 0})
    spark.dataSource.register(fits.FitsSource)
    df = spark.read.format("fits").option("rows_per_partition", 3).load(path)
    got = sorted(df.collect())
    assert df.rdd.getNumPartitions() == 4 and [r.id for r in got] == [10**18 + i for i in range(10)] and got[3].name == "s3" and got[9].x == 1.0 and got[1].ok is False
    assert readers.truth_list(spark, str(tmp_path / "t.fits")).filter("ra IS NULL").count() == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("GC", "NGC 1/2", 1.0, 2.0), ("OC", "b", float("nan"), 3.0)], "kind string, name string, x double, y_master double")
    sinks.per_object(df, str(tmp_path / "o"), "kind", "name")
    assert {r.name for r in spark.read.csv(str(tmp_path / "o"), header=True).select("name").collect()} == {"NGC_1_2", "b"}
    assert sinks.json_rows(df.filter("kind = 'OC'")).first().json == '{"kind":"OC","name":"b","x":null,"y_master":3.0}'
    sinks.with_new_columns(df, str(tmp_path / "n"), z=F.lit(1))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.with_new_columns(df, str(tmp_path / "n"), z=F.lit(1))
    sinks.chunks(df, str(tmp_path / "c"), 2, "name")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_stream_equals_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = growing.growing_histogram(rows, "value", 0, 100, 10, ["event_type"]).writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = growing.growing_histogram(events, "value", 0, 100, 10, ["event_type"])
    assert {tuple(r)[:3] for r in spark.table("bins").collect()} == {tuple(r)[:3] for r in want.collect()}


def test_names(spark):
    a = spark.createDataFrame([("NGC 5139",), ("ngc_104",), ("Other",)], "n string")
    b = spark.createDataFrame([("NGC_5139",), ("NGC_104",)], "m string")
    assert {r.n: r.matched_name for r in keyed_join.by_name(a, b, "n", "m").collect()} == {"NGC 5139": "NGC_5139", "ngc_104": "NGC_104", "Other": None}
    assert [tuple(r) for r in keyed_join.by_containment(spark.createDataFrame([("omega cen",), ("abc",)], "n string"), spark.createDataFrame([("mega",), ("x omega cen y",)], "m string"), "n", "m").orderBy("r").collect()] == [("omega cen", "mega"), ("omega cen", "x omega cen y")]
