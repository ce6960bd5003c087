"""Unknown values, however written, are null from the reader on, and operators that are given NaN count it as unknown."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.stats import without_nan
from skyloom.operators import mixture, robust
from skyloom.operators.quantiles import medians, quantiles
from skyloom.sources import columns, fits, sinks
from skyloom.sources import text as readers

NAN, INF = math.nan, math.inf


@pytest.mark.parametrize("bounds", [{}, {"whole_rows": 0}, {"whole_rows": 0, "few": 2}, {"n_rows": 100}])
def test_quantiles_of_nan_and_infinities(spark, bounds):
    values = [float(i) for i in range(10)] + [NAN] * 3 + [INF, -INF, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", NAN), ("b", None)], "k string, v double")
    got = quantiles(df, ["k"], "v", {"mid": 0.5, "p95": 0.95}, **bounds).collect()
    assert [(r.k, r.n, r.mid, r.p95) for r in got] == [("a", 10, 4.5, pytest.approx(8.55))]
    assert medians(df.filter("k = 'b'"), [], "v", **bounds).count() == 0


def test_robust_means_take_nan_for_null(spark):
    values = [("a", 1.0, 0.1), ("a", 1.2, None), ("a", None, 0.2), ("b", 5.0, 0.5), ("b", 7.0, 0.5), ("b", 6.0, None)]
    given = [("a", 1.0, 0.1), ("a", 1.2, NAN), ("a", NAN, 0.2), ("b", 5.0, 0.5), ("b", 7.0, 0.5), ("b", 6.0, INF), ("b", -INF, 0.1)]
    a, b = (spark.createDataFrame(x, "k string, v double, e double") for x in (values, given))
    for f in (
        lambda d: robust.clipped_weighted_mean(d, ["k"], "v", "e"), lambda d: robust.median_mad(d, ["k"], "v"), lambda d: robust.mad_clipped_mean(d, ["k"], "v"),
        lambda d: robust.mean_error_and_scatter(d, ["k"], "v", "e"), lambda d: d.groupBy("k").agg(*robust.inverse_variance(F.col("v"), F.col("e"))), lambda d: robust.weighted_covariance(d, ["k"], "v", "e", "e"),
    ):
        assert sorted(map(tuple, f(a).collect())) == sorted(map(tuple, f(b).collect()))


def test_deconvolved_mixture_with_a_nan_error(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.3, 300), rng.normal(1, 3, 100)]
    df = lambda e: spark.createDataFrame([(float(v), e if i == 7 else 0.2) for i, v in enumerate(x)], "x double, e double")
    a, b = (mixture.fit_deconvolved(df(e), "x", "e", -20.0, 20.0, iterations=5) for e in (None, NAN))
    assert (a.share, *a.core, *a.tail) == pytest.approx((b.share, *b.core, *b.tail)) and math.isfinite(a.share)


def test_fits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.1), (1.2, None), (None, 0.2)], "v double, e double").coalesce(1)
    sinks.with_new_columns(df, str(tmp_path / "t"), fits=True)
    back = spark.read.format("fits").load(str(next((tmp_path / "t").iterdir())))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one = robust.clipped_weighted_mean(back.withColumn("k", F.lit(1)), ["k"], "v", "e").first()
    assert (one.n, one.mean, one.err) == (2, 1.0, 0.1) and robust.median_mad(back.withColumn("k", F.lit(1)), ["k"], "v").first().n == 2


def test_text_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1.5,nan\nNaN,2\n-Infinity,Inf\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv"), nanValue="NaN", positiveInf="Inf", negativeInf="-Infinity").select("a").collect()] == [(1.5,), (None,), (None,)]
    (tmp_path / "t.dat").write_text("1.5 nan\nNaN Infinity\n")
    assert [tuple(r) for r in readers.blank_separated(spark, str(tmp_path / "t.dat"), {"x": (0, "double"), "y": (1, "float")}).collect()] == [(1.5, None), (None, None)]
    assert [tuple(r) for r in readers.fixed_width(spark, str(tmp_path / "t.dat"), {"x": (0, 3), "y": (4, 12)}).collect()] == [(1.5, None), (None, None)]
    df = spark.createDataFrame([(NAN, [1.0, NAN], 1)], "RA double, x array<double>, n int")
    assert columns.with_aliases(df, {"ra": []}).first().ra is None
    assert tuple(without_nan(df).first()) == (None, [1.0, None], 1)


def test_limited_files_in_one_scan(spark, tmp_path):
    for k, n in enumerate((5, 2, 7)):
        df = spark.range(n).select((F.col("id") + 100 * k).alias("id"), F.lit(NAN).alias("x")).coalesce(1)
        (df if k else df.withColumn("more", F.lit(1))).write.parquet(str(tmp_path / f"f{k}"))
    paths = [str(tmp_path / f"f{k}") for k in (2, 0, 1)]
    got = readers.limited_files(spark, paths, 3, 2).orderBy("id").collect()
    assert [(r.id, r.x, r.more) for r in got] == [(0, None, 1), (1, None, 1), (2, None, 1), (100, None, None), (101, None, None)]
    assert readers.limited_files(spark, paths).count() == 14


def fits_file(path, columns, rows, heap=b""):
    """columns: (name, form, {more cards}); rows: their bytes."""
    card = lambda k, v: (f"{k:<8}= '{v:<8}'" if isinstance(v, str) else f"{k:<8}= {v:>20}").ljust(80)
    block = lambda cards: ("".join(cards) + "END".ljust(80)).ljust(fits.BLOCK * (1 + (80 * len(cards) + 80) // fits.BLOCK)).encode()
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", len(rows[0])), card("NAXIS2", len(rows)), card("PCOUNT", len(heap)), card("GCOUNT", 1), card("TFIELDS", len(columns))]
    for k, (name, form, more) in enumerate(columns, 1):
        cards += [card(f"TTYPE{k}", name), card(f"TFORM{k}", form), *(card(f"{n}{k}", v) for n, v in more.items())]
    data = b"".join(rows) + heap
    path.write_bytes(block([card("SIMPLE", "T".rjust(20)) if False else "SIMPLE  =                    T".ljust(80), card("BITPIX", 8), card("NAXIS", 0)]) + block(cards) + data.ljust(-(-len(data) // fits.BLOCK) * fits.BLOCK, b"\0"))


def test_fits_column_types(spark, tmp_path):
    spark.dataSource.register(fits.FitsSource)
    columns = [
        ("i", "1I", {"TNULL": -99}), ("unsigned", "1J", {"TZERO": 2147483648}), ("big", "1K", {"TZERO": 9223372036854775808}), ("scaled", "1I", {"TSCAL": 0.5, "TZERO": 10, "TNULL": 0}), ("signed", "1B", {"TZERO": -128}),
        ("flag", "1L", {}), ("bits", "11X", {}), ("c", "1C", {}), ("m", "2M", {}), ("v", "1PE(3)", {}), ("w", "1QJ(2)", {"TNULL": 7}), ("s", "1PA(9)", {}), ("f", "3E", {}), ("empty", "0D", {}), ("t", "4A", {}), ("vb", "1PX(9)", {}),
    ]
    heap = struct.pack(">3f", 1, NAN, 3) + struct.pack(">2i", 7, 8) + b"letters" + struct.pack(">f", 9) + bytes([0b10100000, 0b10000000])
    row = lambda i, j, k, h, b, l, x, c, m, v, w, s, f, t, vb: (  # noqa: E731, E741
        struct.pack(">hiqhBc", i, j, k, h, b, l) + x + struct.pack(">2f4d", *c, *m) + struct.pack(">2i", *v) + struct.pack(">2q", *w) + struct.pack(">2i", *s) + struct.pack(">3f", *f) + t + struct.pack(">2i", *vb)
    )
    rows = [
        row(5, -(2**31), -(2**63), 4, 0, b"T", bytes([0b10000001, 0b11100000]), (1, 2), (1, 2, 3, NAN), (3, 0), (2, 12), (7, 20), (1, INF, 2), b"ab \0", (9, 31)),
        row(-99, 2**31 - 1, 2**63 - 1, 0, 255, b"\0", bytes([0, 0]), (NAN, 0), (0, 0, 0, 0), (0, 0), (0, 0), (0, 0), (0, 0, 0), b"a\0zz", (0, 0)),
        row(1, 0, 0, -4, 128, b"F", bytes([255, 255]), (0, 0), (0, 0, 0, 0), (1, 27), (1, 16), (3, 20), (0, 0, 0), b"\0   ", (1, 31)),
    ]
    fits_file(tmp_path / "t.fits", columns, rows, heap)
    df = spark.read.format("fits").option("rows_per_partition", 2).load(str(tmp_path / "t.fits"))
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("i", "unsigned", "big", "scaled", "signed", "bits", "c", "v", "w", "s")] == ["smallint", "bigint", "decimal(20,0)", "double", "smallint", "array<boolean>", "struct<re:float,im:float>", "array<float>", "array<int>", "string"]
    a, b, c = df.collect()
    assert (a.i, b.i, c.i) == (5, None, 1) and (a.unsigned, b.unsigned, c.unsigned) == (0, 2**32 - 1, 2**31) and (a.big, b.big, c.big) == (0, 2**64 - 1, 2**63)
    assert (a.scaled, b.scaled, c.scaled) == (12.0, None, 8.0) and (a.signed, b.signed, c.signed) == (-128, 127, 0) and (a.flag, b.flag, c.flag) == (True, None, False)
    assert a.bits == [True] + [False] * 6 + [True] * 4 and b.bits == [False] * 11 and c.bits == [True] * 11
    assert tuple(a.c) == (1, 2) and tuple(b.c) == (None, 0) and [tuple(x) for x in a.m] == [(1, 2), (3, None)]
    assert (a.v, b.v, c.v) == ([1, None, 3], [], [9]) and (a.w, b.w, c.w) == ([None, 8], [], [8]) and (a.s, b.s, c.s) == ("letters", "", "let")
    assert a.f == [1, None, 2] and (a.t, b.t, c.t) == ("ab", "a", "") and a.vb == [True, False, True] + [False] * 5 + [True] and c.vb == [True] and "empty" not in kinds
    few = spark.read.format("fits").option("columns", "v,i").load(str(tmp_path / "t.fits"))
    assert few.columns == ["v", "i"] and few.first().v == [1, None, 3]
