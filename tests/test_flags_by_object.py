"""Flags of objects whose candidates are no table, against those of the table."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom import catalog, storage
from skyloom.operators import membership as m
from skyloom.operators.whole_objects import flags, members

from .test_whole_objects import sky


@pytest.mark.parametrize("bounds", [{}, {"most": 100}])
def test_flags_are_those_of_the_members(spark, bounds):
    stars, objects = sky(spark)
    stars = stars.withColumn("dist", F.expr("CASE id % 11 WHEN 3 THEN NULL WHEN 4 THEN -dist ELSE dist END"))
    objects = objects.withColumn("ref_dist", F.expr("CASE WHEN object <> 'seam' THEN ref_dist END"))
    found = members(stars, objects, 3.0, "OC", keep=("dist", "rv")).join(objects.select("object", "ref_dist"), "object")
    more = {"ref_err": F.lit(None).cast("double"), "ref_rv": F.lit(0.0), "ref_sigma": F.lit(100.0)}
    want = m.quality_flags(found.withColumns(more), "dist", "ref_dist", "ref_err", "rv", "ref_rv", "ref_sigma")
    a, b = (t.toPandas().sort_values("object").reset_index(drop=True) for t in (flags(stars, objects, 3.0, "OC", (0.0, 100.0), **bounds), want))
    assert {"seam", "pole", "plain", "few"} <= set(a.object) and a.ks_d.notna().any() and a.rv_ks_p.notna().any() and a.ks_d.isna().any()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    assert flags(stars.limit(0), objects, 3.0, "OC", (0.0, 100.0)).count() == 0


def test_no_table_of_pairs_is_written(spark, tmp_path, monkeypatch):
    """The flags were made of a written row for each object and star near it."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    n = catalog.queries()["M17_quality_flags"](spark, "/root/testdata/sf0.01").count()
    assert n == 1500 and max(spark.read.parquet(f"file://{tmp_path}/{d}").count() for d in os.listdir(tmp_path)) < 397_415 / 2
