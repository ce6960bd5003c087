"""Medians and deviations of groups, small and large ones by their own ways, against NumPy's."""

import numpy as np
import pytest

from skyloom.operators import quantiles
from skyloom.operators.quantiles import medians
from skyloom.operators.robust import median_mad
from skyloom.storage import stored

from . import test_quantiles as odd


@pytest.mark.parametrize("bounds", [{}, {"whole_rows": 0}, {"whole_rows": 0, "small": 50}, {"whole_rows": 0, "small": 0}, {"whole_rows": 0, "small": 50, "keep": False}])
def test_both_ways(spark, bounds):
    rng = np.random.default_rng(4)
    groups = {"one": np.array([7.0]), "two": np.array([1.0, 2.0]), "even": np.round(rng.uniform(0, 9, 60)), "odd": rng.normal(0, 1, 31), "large": rng.lognormal(0, 3, 999), "alike": np.full(80, -2.5)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("odd", None), ("odd", float("nan")), ("two", float("inf")), ("none", None), (None, 3.0)]
    got = {r.k: r for r in median_mad(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", 2.0, **bounds).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        m = np.median(x)
        assert (got[k].n, got[k].median, got[k].mad) == (len(x), pytest.approx(m, rel=1e-12), pytest.approx(2 * np.median(np.abs(x - m)), rel=1e-12, abs=1e-15)), k


def test_many_small_groups_have_no_cells(spark, monkeypatch):
    """Four hundred thousand groups of three rows: as cells they would be as many as their rows, written and sorted by each group."""
    made = []
    monkeypatch.setattr(quantiles, "stored", lambda df, name: made.append(name) or stored(df, name))
    rows = spark.range(1_200_000).selectExpr("id % 400000 AS k", "CAST(id * 31 % 997 AS DOUBLE) AS v")
    out = median_mad(rows, ["k"], "v")
    one = out.agg({"n": "sum", "k": "count"}).first()
    assert (one["sum(n)"], one["count(k)"]) == (1_200_000, 400_000)
    assert medians(rows, ["k"], "v").count() == 400_000
    assert "cells" not in made


@pytest.mark.parametrize("bounds", [{"small": 0}, {"small": 0, "few": 3}, {"small": 100}])
def test_medians_of_cut_groups(spark, bounds):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 = 0 THEN id % 400 END AS k", "CAST(id * 7919 % 5003 AS DOUBLE) AS v")
    want = rows.toPandas().groupby("k", dropna=False).v.median()
    got = medians(rows, ["k"], "v", whole_rows=0, **bounds).toPandas().set_index("k")["median"]
    assert len(got) == len(want) and np.allclose(np.sort(got), np.sort(want))


@pytest.mark.parametrize("bounds", [{"whole_rows": 0, "small": 0}, {"whole_rows": 0, "small": 0, "few": 3}, {"whole_rows": 0, "small": 1000, "few": 3}])
def test_odd_groups_cut(spark, bounds):
    odd.test_quantiles(spark, bounds)


def test_groups_are_told_in_one_pass(spark):
    from skyloom.operators.quantiles import large_groups

    rows = spark.range(1000).selectExpr("id % 3 AS k", "CAST(id AS double) AS _v")
    told = lambda df, small, whole: (lambda large, every: (large and large.count(), every))(*large_groups(df, ["k"], small, whole))
    assert told(rows, 100, 10) == (3, True) and told(rows, 333, 10) == (1, False) and told(rows, 500, 10) == (None, False) == told(rows, 100, 1000) == told(rows.limit(0), 1, 0)
