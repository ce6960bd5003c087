"""Membership over every object, against brute force."""

import numpy as np
import pytest

from skyloom import catalog
from skyloom.plans.adapters import detections, stars


def _sep(o, d):
    a, b, c, e = (np.radians(x) for x in (o.ra.to_numpy()[:, None], o.dec.to_numpy()[:, None], d.ra.to_numpy()[None], d.dec.to_numpy()[None]))
    h = np.sin((e - b) / 2) ** 2 + np.cos(b) * np.cos(e) * np.sin((c - a) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


@pytest.mark.parametrize("name", ["M9_mixture_membership", "M10_density_membership", "M10_hierarchical_membership", "M11_hybrid_membership", "M12_stream_membership", "M14_bayesian_membership"])
def test_every_star_is_an_object(spark, sf, name):
    o, d = stars(spark, sf).toPandas(), detections(spark, sf).toPandas()
    i, j = np.nonzero(_sep(o, d) <= 3.0)
    want = set(zip(o.name.to_numpy()[i], d.id.to_numpy()[j].tolist()))
    got = catalog.queries()[name](spark, sf).select("object", "id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len({w[0] for w in want}) > len(o) // 2


def test_every_object_has_flags(spark, sf):
    o, d = stars(spark, sf).toPandas(), detections(spark, sf).toPandas()
    want = set(o.name[(_sep(o, d) <= 3.0).any(axis=1)])
    assert {r.object for r in catalog.queries()["M17_quality_flags"](spark, sf).collect()} == want
