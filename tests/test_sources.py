"""Layouts of text files, files by pattern, FITS chunks, pixels and motion in space."""

import csv
import gzip
import io
import json
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.sources import fits, sinks
from skyloom.sources import text as readers


def line(slices, **values):
    out = [" "] * max(b for _, b in slices.values())
    for name, value in values.items():
        a, b = slices[name]
        assert len(value) <= b - a
        out[a : a + len(value)] = value
    return "".join(out)


@pytest.mark.parametrize("survey", sorted(readers.SURVEY_SLICES))
def test_survey_layouts(spark, tmp_path, survey):
    cut = readers.SURVEY_SLICES[survey]
    rows = [line(cut, sid="4611686018427387904", ra="12.5", dec="-3.25", rv="-17.5", erv="0.25", srv="1"), line(cut, sid="1", rv="5", erv="0"), line(cut, sid="2", rv="nan", erv="1"), line(cut, sid="3", erv="1"), "short"]
    name = survey.lower()
    (tmp_path / f"{name}.dat").write_text(rows[1] + "\n")
    with gzip.open(tmp_path / f"{name}.dat.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    want = [("4611686018427387904", 12.5, -3.25, -17.5, 0.25, 1.0, survey)]
    assert [tuple(r) for r in readers.survey_velocities(spark, str(tmp_path), survey).collect()] == want
    assert readers.survey_velocities(spark, str(tmp_path / f"{name}.dat"), survey).count() == 0


@pytest.mark.parametrize("name", sorted(readers.LITERATURE))
def test_literature_layouts(spark, tmp_path, name):
    known = readers.LITERATURE[name]
    cut, degrees = known["slices"], not known["sexagesimal"]
    place = {"ra": "187.5", "dec": "-1.5"} if degrees else {"ra": "12 30 00.0", "dec": "-01 30 00.0"}
    full = line(cut, **place, rv="55.5", erv="2.5").ljust(110)
    rows = [full, line(cut, **place, rv="55.5", erv="-").ljust(110), line(cut, **place, erv="1").ljust(110), line(cut, rv="5").ljust(110), full[: known["least"] - 1]]
    (tmp_path / "t.dat").write_text("\n".join(rows) + "\n")
    got = readers.literature_table(spark, str(tmp_path / "t.dat"), name).collect()
    assert [(r.ra, r.dec, r.rv, r.erv) for r in got] == [(187.5, -1.5, 55.5, 2.5), (187.5, -1.5, 55.5, None)]


def test_files_by_pattern(spark, tmp_path):
    for n in ("b_chunk2.fits", "a_chunk1.fits", "other.fits"):
        (tmp_path / n).write_text("")
    names = lambda *a: [Path(p).name for p in readers.files_of(spark, str(tmp_path), *a)]
    assert names(["all_chunk*.fits", "*_chunk*.fits", "*.fits"]) == ["a_chunk1.fits", "b_chunk2.fits"]
    assert names(["*.fits"], 1) == ["a_chunk1.fits"]
    with pytest.raises(FileNotFoundError):
        names(["*.csv"])


def test_fits_chunks(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 2 == 0, F.col("id").cast("float")).alias("f"), F.concat(F.lit("é"), "id").alias("name"), (F.col("id") % 3 == 0).alias("ok"), F.col("id").cast("int").alias("k"))
    out = tmp_path / "chunks"
    sinks.chunks(df, str(out), 3, "id", fits=True)
    files = sorted(out.iterdir())
    assert len(files) == 3 and all(f.name.startswith("chunk-") and f.stat().st_size % fits.BLOCK == 0 for f in files)
    found = [r for f in files for r in spark.read.format("fits").load(str(f)).collect()]
    want = {r.id: r for r in df.collect()}
    assert len(found) == 5000 and all((r.id, r.x, r.ok, r.k) == (want[r.id].id, want[r.id].x, want[r.id].ok, want[r.id].k) for r in found)
    assert all(r.f == want[r.id].f for r in found)
    sinks.chunks(df, str(out), 5, "id", fits=True)  # there already
    assert len(list(out.iterdir())) == 3
    few = spark.read.format("fits").option("columns", "x, nothing, id").load(str(files[0]))
    assert few.columns == ["x", "id"] and few.filter("x <> id / 7D").isEmpty()
    sinks.with_new_columns(df, str(tmp_path / "more"), fits=True, y=F.col("x") + 1)
    with pytest.raises(FileExistsError):
        sinks.with_new_columns(df, str(tmp_path / "more"), fits=True, y=F.lit(1))
    for bad in (df.select(F.lit("x" * 65).alias("t")), df.select(F.when(F.col("id") > 9, F.col("id")).alias("t"))):
        with pytest.raises(Exception, match="over 64 bytes|a null in"):
            bad.write.format("fits").mode("append").save(str(tmp_path / "bad"))


def test_json_per_object(spark, tmp_path):
    df = spark.createDataFrame([("GC", "NGC 1/2", 1.0), ("OC", "b", float("nan"))], "kind string, name string, x double")
    sinks.per_object(df, str(tmp_path / "o"), "kind", "name", json=True)
    lines = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "o").rglob("*.json")}
    assert lines == {"name=NGC_1_2": {"x": 1.0}, "name=b": {"x": None}}


def test_nested_pixels(spark):
    rng = np.random.default_rng(4)
    z = np.r_[rng.uniform(-1, 1, 20_000), 2 / 3, -2 / 3]
    df = spark.createDataFrame([(float(a), float(d)) for a, d in zip(np.r_[rng.uniform(0, 360, 20_000), 45, 300], np.degrees(np.arcsin(z)))], "ra double, dec double")
    ra, dec = F.col("ra"), F.col("dec")
    p = df.select(*(sky.healpix_nested(ra, dec, n).alias(f"n{n}") for n in (1, 8, 16)), *(sky.healpix_ring(ra, dec, n).alias(f"r{n}") for n in (1, 8))).toPandas()
    # a pixel's children are numbered within it, base pixels are the same in both orders, and each ring pixel is one nested pixel
    assert (p.n16 // 4 == p.n8).all() and (p.n8 // 64 == p.n1).all() and (p.n1 == p.r1).all()
    assert len(p[["n8", "r8"]].drop_duplicates()) == p.n8.nunique() == p.r8.nunique() == 768
    poles = spark.range(1).select(sky.healpix_nested(F.lit(45.0), F.lit(90.0), 4), sky.healpix_nested(F.lit(45.0), F.lit(-90.0), 4)).first()
    assert tuple(poles) == (15, 128)


def test_motion_in_space(spark):
    rows = [(10.0, 20.0, 500.0, -300.0, None, None), (10.0, 20.0, None, 1.0, 5.0, 1.0), (359.9999999, 0.0, 1000.0, 0.0, None, None), (80.0, 89.9999, 9000.0, 4000.0, 100.0, 0.0013)]
    df = spark.createDataFrame(rows, "ra double, dec double, pmra double, pmdec double, rv double, kpc double")
    got = df.select(*sky.space_motion(*(F.col(c) for c in ("ra", "dec", "pmra", "pmdec")), F.lit(15.5), F.col("rv"), F.col("kpc"))).collect()
    for (ra, dec, pa, pd, rv, kpc), (a, d) in zip(rows, got):
        if pa is None:
            assert (a, d) == (ra, dec)
            continue
        t, s = np.radians([ra, dec]), 15.5 / 3.6e6
        r = np.array([math.cos(t[1]) * math.cos(t[0]), math.cos(t[1]) * math.sin(t[0]), math.sin(t[1])])
        east, north = np.array([-math.sin(t[0]), math.cos(t[0]), 0]), np.array([-math.sin(t[1]) * math.cos(t[0]), -math.sin(t[1]) * math.sin(t[0]), math.cos(t[1])])
        v = r * (1 + (rv / kpc if rv else 0) * 3.15576e7 / 3.0856775814913673e16 * 15.5) + math.radians(pa * s) * east + math.radians(pd * s) * north
        assert a == pytest.approx(math.degrees(math.atan2(v[1], v[0])) % 360, abs=1e-9) and d == pytest.approx(math.degrees(math.asin(v[2] / np.linalg.norm(v))), abs=1e-9)


def _one_text(folder):
    return "".join(p.read_text() for p in sorted(folder.rglob("part-*")))


def test_csv_in_chunks_has_one_header(spark, tmp_path):
    """Appended chunks are one file with one header, a broken one is written over, and quotes, commas and blanks come back."""
    rows = [(1, 'a "q", b', 1.5), (2, " x ", float("nan")), (3, None, 2.0), (4, "two\nlines", 4.0)]
    kinds = "id long, `na,me` string, x double"
    out = tmp_path / "o"
    assert sinks.csv_chunk(spark.createDataFrame(rows, kinds).repartition(3), str(out)) == 0
    (out / "chunk-00000001").mkdir()
    (out / "chunk-00000001" / "part-00000-broken.txt").write_text("9,half")
    assert sinks.csv_chunk(spark.createDataFrame([(5, "e", 0.5)], kinds), str(out)) == 1
    assert sinks.csv_chunk(spark.createDataFrame([], kinds), str(out)) == 2
    got = pd.read_csv(io.StringIO(_one_text(out)))
    assert list(got.columns) == ["id", "na,me", "x"] and _one_text(out).startswith('id,"na,me",x\n')
    got = {r[0]: r[1:] for r in got.astype(object).where(got.notna(), None).itertuples(index=False, name=None)}
    assert got == {1: ('a "q", b', 1.5), 2: (" x ", None), 3: (None, 2.0), 4: ("two\nlines", 4.0), 5: ("e", 0.5)}
    sinks.csv_chunk(spark.createDataFrame([(None,), ("v",)], "only string").coalesce(1), str(tmp_path / "one"))
    assert _one_text(tmp_path / "one") == 'only\n""\nv\n'


def test_results_of_a_run_over_objects(spark, tmp_path):
    """All rows, the summary with the most matched first, and the algorithms as one JSON document, against plain Python."""
    rows = spark.createDataFrame([("a", "OC", k, 0.1 * k) for k in range(11)] + [("b", "GC", k, None) for k in range(3)] + [('c "x"', "OC", 1, float("nan"))], "object string, kind string, id long, p_member double")
    info = spark.createDataFrame([("b", "GC", 6, "em", "ok", 1.5, [1]), ("a", "OC", 40, "density", "ok", None, [2, 3]), ('c "x"', "OC", 0, "density", "no_cluster", float("inf"), []), ("d", "DW", 7, "em", "insufficient_data", 0.0, None)], "object string, kind string, n_members long, algorithm string, status string, scale double, steps array<int>")
    sinks.object_results(rows, info.repartition(3), str(tmp_path))
    full = pd.read_csv(io.StringIO(_one_text(tmp_path / "full")))
    assert list(full.columns) == ["kind", "object", "id", "p_member"] and len(full) == 15
    assert [tuple(r.values()) for r in csv.DictReader(io.StringIO(_one_text(tmp_path / "summary")))] == [
        ("a", "OC", "40", "11", "27.5", "2", "density", "ok"),
        ("b", "GC", "6", "3", "50.0", "0", "em", "ok"),
        ('c "x"', "OC", "0", "1", "", "0", "density", "no_cluster"),
        ("d", "DW", "7", "0", "0.0", "0", "em", "insufficient_data"),
    ]
    about = json.loads(_one_text(tmp_path / "algorithms"))
    assert about == {
        "DW_d": {"algorithm": "em", "status": "insufficient_data", "scale": 0.0, "steps": None},
        "GC_b": {"algorithm": "em", "status": "ok", "scale": 1.5, "steps": [1]},
        "OC_a": {"algorithm": "density", "status": "ok", "scale": None, "steps": [2, 3]},
        'OC_c "x"': {"algorithm": "density", "status": "no_cluster", "scale": None, "steps": []},
    } and list(about) == sorted(about)
    sinks.json_document(info.limit(0), str(tmp_path / "none"), "status")
    assert json.loads(_one_text(tmp_path / "none")) == {}
