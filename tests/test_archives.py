"""NumPy archives, cached results, and points in outlines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import stats
from skyloom.operators import binning
from skyloom.sources.npz import NpzSource
from skyloom.storage import cached


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    spark.dataSource.register(NpzSource)
    n = 1000
    a = {"x": np.arange(n) / 7, "k": np.arange(n, dtype="u2"), "p": np.arange(3 * n, dtype="f4").reshape(n, 3), "name": np.array([f"é{i}" for i in range(n)]), "ok": np.arange(n) % 3 == 0, "big": np.arange(n, dtype="u8") + 2**63, "other": np.zeros(3)}
    a["x"][5], a["p"][7, 1] = np.nan, np.inf
    save(tmp_path / "a.npz", **a)
    got = spark.read.format("npz").option("rows_per_partition", 300).load(str(tmp_path / "a.npz"))
    assert dict(got.dtypes) == {"x": "double", "k": "int", "p": "array<float>", "name": "string", "ok": "boolean", "big": "decimal(20,0)"} and got.rdd.getNumPartitions() == 4
    rows = sorted(got.collect(), key=lambda r: r.k)
    assert [r.x for r in rows] == [None if i == 5 else i / 7 for i in range(n)] and rows[7].p == [21, None, 23] and rows[999].name == "é999" and rows[3].ok and rows[999].big == 2**63 + 999
    few = spark.read.format("npz").option("arrays", "ok,k").load(str(tmp_path / "a.npz"))
    assert few.columns == ["ok", "k"] and few.count() == n
    with pytest.raises(Exception, match="different lengths"):
        spark.read.format("npz").option("arrays", "other,k").load(str(tmp_path / "a.npz")).count()


def test_single_arrays_and_no_pickles(spark, tmp_path):
    spark.dataSource.register(NpzSource)
    np.save(tmp_path / "v.npy", np.arange(10, dtype=">i4"))
    assert [r.value for r in spark.read.format("npz").load(str(tmp_path / "v.npy")).collect()] == list(range(10))
    np.save(tmp_path / "s.npy", np.array([(1, 2.5, b"ab"), (2, np.nan, b"c")], dtype=[("a", "i8"), ("b", "f8"), ("c", "S4")]))
    assert [tuple(r) for r in spark.read.format("npz").load(str(tmp_path / "s.npy")).collect()] == [(1, 2.5, "ab"), (2, None, "c")]
    np.savez(tmp_path / "o.npz", o=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="pickled"):
        spark.read.format("npz").load(str(tmp_path / "o.npz")).count()


def test_cached_results(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    built = []

    def result(**parameters):
        def build():
            built.append(parameters)
            return spark.read.parquet(str(tmp_path / "in")).filter(F.col("id") >= parameters["least"])

        return cached(spark, "sums", [str(tmp_path / "in")], parameters, build, str(tmp_path / "cache")).count()

    assert result(least=3) == 7 and len(built) == 1
    spark.sparkContext.setJobGroup("again", "")
    assert result(least=3) == 7 and len(built) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("again")) <= 3  # reading what is there: schema and count
    assert result(least=5) == 5 and len(built) == 2
    spark.range(100, 103).write.mode("append").parquet(str(tmp_path / "in"))
    assert result(least=3) == 10 and len(built) == 3
    next((tmp_path / "cache").glob("sums-*/_SUCCESS")).unlink()
    assert result(least=3) == 10 and result(least=5) == 8 and len(built) >= 4


def test_points_on_edges(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    cases = {(1, 1): True, (0, 1): True, (1, 0): True, (0, 0): True, (2, 1): False, (1, 2): False, (2, 2): False, (3, 1): False, (-1, 1): False}
    notch = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in cases] + [(None, 1.0)], "x double, y double")
    got = {(r.x, r.y): r.inside for r in df.withColumn("inside", stats.in_polygon(F.col("x"), F.col("y"), square)).collect()}
    assert got.pop((None, 1.0)) in (None, False) and got == {(float(x), float(y)): v for (x, y), v in cases.items()}
    inside = stats.in_polygon(F.lit(2.0), F.lit(2.0), notch), stats.in_polygon(F.lit(0.5), F.lit(2.0), notch)
    assert tuple(df.limit(1).select(*inside).first()) == (False, True)


def test_smoothed_map_keeps_the_sum(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (6, 3, 2.0), (6, 3, 1.0)], "bx long, by long, v double")
    got = binning.smoothed_map(df, "v", 7, 4, 2.0)
    assert got.count() == 28 and got.agg(F.sum("v")).first()[0] == pytest.approx(8.0)
