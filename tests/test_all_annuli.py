"""Annuli about every star, against brute force."""

import numpy as np

from skyloom import catalog
from skyloom.plans.adapters import detections, stars


def _sep(o, d):
    a, b, c, e = (np.radians(x) for x in (o.ra.to_numpy()[:, None], o.dec.to_numpy()[:, None], d.ra.to_numpy()[None], d.dec.to_numpy()[None]))
    h = np.sin((e - b) / 2) ** 2 + np.cos(b) * np.cos(e) * np.sin((c - a) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


def test_annuli_about_every_star(spark, sf):
    o, d = stars(spark, sf).toPandas(), detections(spark, sf).toPandas()
    s = _sep(o, d)
    n = ((s > 0.5) & (s <= 1.5)).sum(axis=1)
    want = {int(i): round(k / (np.pi * 2), 8) for i, k in zip(o.id, n) if k}
    got = {r.centre: r.density for r in catalog.queries()["A33_annulus_density"](spark, sf).collect()}
    assert len(want) > len(o) // 50 and got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
