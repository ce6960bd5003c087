"""Membership of objects in tasks that read the stars about them once, against candidates as a table and against brute force."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from skyloom import catalog, storage
from skyloom.operators import membership as m
from skyloom.operators.near_points import components, density_labels, nearest
from skyloom.operators.whole_objects import members

from .test_density import brute_dbscan


def test_arrays_have_the_labels_and_neighbours_of_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(30):
        eps, least = rng.choice([0.25, 0.4, 0.1]), int(rng.choice([1, 3, 5]))
        parts, want = [], []
        for n in rng.integers(1, 120, 4):
            p = np.concatenate([rng.normal(rng.normal(size=2), 0.15, (n // 2, 2)), rng.uniform(-2, 2, (n - n // 2, 2))])
            parts.append(np.round(p, 1) if trial % 3 == 0 else p)
            want += [-1 if v is None else v for v in brute_dbscan(parts[-1].tolist(), eps, least)[0]]
        p, of, rank = np.concatenate(parts), np.repeat(np.arange(4), [len(v) for v in parts]), np.concatenate([np.arange(len(v)) for v in parts])
        assert density_labels(of, rank, p[:, 0], p[:, 1], eps, least).tolist() == want
        q, q_of = rng.normal(size=(40, 2)) * 3, np.sort(rng.integers(0, 5, 40))
        got = nearest(q_of, q[:, 0], q[:, 1], of, p[:, 0], p[:, 1], 3)
        for i in range(40):
            d = np.sort(np.hypot(*(p[of == q_of[i]] - q[i]).T))[:3]
            assert got[i].tolist() == [*d, *[math.inf] * (3 - len(d))]
    assert components(7, np.array([5, 3, 1]), np.array([3, 4, 0])).tolist() == [0, 0, 2, 3, 3, 3, 6]
    none = np.zeros(0)
    assert len(density_labels(none.astype(int), none, none, none, 0.1, 3)) == 0 and len(nearest(none.astype(int), none, none, none.astype(int), none, none, 1)) == 0


def sky(spark):
    """Objects across the seam and about a pole, one with few stars, one unnamed; stars whose motion, place or speed may be unknown."""
    rng = np.random.default_rng(3)
    objects, stars = [], []
    for k, (name, ra, dec, n, kind) in enumerate([("seam", 0.1, 5.0, 90, "SGR"), ("pole", 30.0, 89.5, 80, "OC"), ("plain", 120.0, -40.0, 150, None), ("near", 120.8, -40.3, 0, "HYBRID"), ("few", 200.0, 0.0, 8, "GC"), (None, 250.0, 0.0, 30, "OC"), ("alone", 300.0, 0.0, 0, "GC"), ("tree", 340.0, -10.0, 60, "HDBSCAN")]):
        objects.append((name, ra, dec, 30.0 if k % 2 else None, 0.3 if k % 3 else None, 20.0, 2.0 if k % 2 else None, -1.0 if k % 2 else None, 12.0, kind))
        if name in ("seam", "pole"):
            objects[-1] = (*objects[-1][:3], 60.0, *objects[-1][4:])
        for i in range(n):
            mine = i % 3 == 0
            pm = rng.normal((2, -1), 0.2) if mine else rng.normal(0, 3, 2)
            at = (ra + rng.normal(0, 0.3) / max(math.cos(math.radians(dec)), 0.02), min(dec + rng.normal(0, 0.3), 90.0))
            stars.append((len(stars), *map(float, at), *map(float, pm), 0.1, 0.2, 0.3, float(rng.normal(40 if mine else 0, 9 if mine else 80)) if i % 5 else None, 2.0 if i % 7 else None, float(rng.normal(12, 1)), 0.5))
    stars += [(9000, None, 1.0, 1.0, 1.0, *[0.1] * 7), (9001, 120.0, -40.0, None, 1.0, *[0.1] * 7), (9002, 120.1, -40.0, math.nan, 1.0, *[0.1] * 7), (9003, math.inf, 1.0, 1.0, 1.0, *[0.1] * 7), (9004, 120.2, -40.0, math.inf, 1.0, *[0.1] * 7)]
    stars = spark.createDataFrame(stars, "id long, ra double, dec double, pmra double, pmdec double, e_pmra double, e_pmdec double, rho double, rv double, e_rv double, dist double, e_dist double")
    objects = spark.createDataFrame(objects, "object string, o_ra double, o_dec double, rhalf_arcmin double, ellipticity double, pa double, ref_pmra double, ref_pmdec double, ref_dist double, kind string")
    return stars, objects


@pytest.mark.parametrize("method", ["GC", "OC", "SGR", "GMM", "HYBRID", "HDBSCAN", None])
def test_members_are_those_of_the_table_of_candidates(spark, method):
    stars, objects = sky(spark)
    tables = [t.toPandas().assign(object=lambda d: d.object.fillna("")).sort_values(["object", "id"]).reset_index(drop=True) for t in (members(stars, objects, 3.0, method), m.membership(m.candidates(stars.filter("ra < double('inf')"), objects, 3.0), method))]
    assert len(tables[0]) > 400 and {"seam", "pole", "near", ""} <= set(tables[0].object) and "alone" not in set(tables[0].object)
    pd.testing.assert_frame_equal(tables[0].drop(columns="p_member"), tables[1].drop(columns="p_member"))
    assert tables[0].p_member.tolist() == pytest.approx(tables[1].p_member.tolist(), abs=1e-6, nan_ok=True)
    assert members(stars.limit(0), objects, 3.0, method).count() == 0 and members(stars, objects.limit(0), 3.0, method).count() == 0


def test_crowded_cells_go_by_joins_and_parts_change_nothing(spark):
    stars, objects = sky(spark)
    want = {(r.object, r.id): r.p_member for r in members(stars, objects, 3.0, "OC").collect()}
    for bounds in ({"most": 100}, {"objects_a_task": 1}):
        got = {(r.object, r.id): r.p_member for r in members(stars, objects, 3.0, "OC", **bounds).collect()}
        assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-9)


def test_no_table_of_pairs_is_written(spark, tmp_path, monkeypatch):
    """The stream's query wrote a row for each object and star near it, several times."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    n = catalog.queries()["M12_stream_membership"](spark, "/root/testdata/sf0.01").count()
    assert n == 397_415 and max(spark.read.parquet(f"file://{tmp_path}/{d}").count() for d in os.listdir(tmp_path)) < n / 2


def test_columns_of_stars_come_along(spark):
    stars, objects = sky(spark)
    want = {r.id: (r.dist, r.rv) for r in stars.collect()}
    for most in (1 << 16, 100):
        got = members(stars, objects.filter("object IN ('plain', 'near')"), 3.0, "GMM", most=most, keep=("dist", "rv")).collect()
        assert len(got) > 150 and all((r.dist, r.rv) == want[r.id] for r in got)
