"""Quantiles by refinement against NumPy's."""

import numpy as np
import pandas as pd
import pytest

from skyloom.operators.quantiles import medians, quantiles

PROBS = {"lo": 0.01, "mid": 0.5, "q": 0.8, "hi": 0.99, "least": 0.0, "most": 1.0}


@pytest.mark.parametrize("bounds", [{}, {"whole_rows": 0}, {"whole_rows": 0, "few": 3}])
def test_quantiles(spark, bounds):
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(0, 1, 3000), "b": np.r_[np.zeros(500), rng.lognormal(0, 3, 500)], "c": np.array([7.0]), "d": np.repeat([-3.0, 2.5], 40), "e": 1e6 + rng.random(2000) * 1e-3, None: -rng.random(33), "f": np.round(rng.uniform(0, 50, 900))}
    pdf = pd.DataFrame([(k, v) for k, x in groups.items() for v in x], columns=["k", "v"])
    rows = [(k, float(v)) for k, v in pdf.itertuples(index=False)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r for r in quantiles(df, ["k"], "v", PROBS, **bounds).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12), (k, name)
    whole = quantiles(df, [], "v", {"m": 0.5}, **bounds).collect()
    assert len(whole) == 1 and whole[0].m == pytest.approx(np.median(pdf.v)) and set(whole[0].asDict()) == {"n", "m"}
    assert medians(df.limit(0), ["k"], "v", **bounds).count() == 0
