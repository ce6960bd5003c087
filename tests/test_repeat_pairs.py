"""Pairs of a star's repeats, against a loop."""

import math
import random

from skyloom.operators.velocity import repeat_pairs


def _loop(rows, most_rows=30, most_pairs=200, ratio=5.0):
    out, groups = [], {}
    for s, k, row_id, rv, err in rows:
        groups.setdefault((s, k), []).append((err, row_id, rv))
    for (s, _), m in groups.items():
        m = sorted(m)[:most_rows]
        n = 0
        for i, (e, _, v) in enumerate(m):
            for f, _, w in m[i + 1 :]:
                if v is not None and w is not None and f <= e * ratio and abs(v - w) >= 1e-6 and n < most_pairs:
                    n += 1
                    out.append((s, (v - w) / math.sqrt(e * e + f * f)))
    return sorted(out, key=str)


def test_pairs_are_those_of_a_loop(spark):
    """Stars that lie across batches, over 30 rows, over 200 pairs, alone, unknown, and equal velocities."""
    r = random.Random(5)
    rows = [(s, k, i, r.choice([None, 1.0, 1.0 + 1e-7, r.uniform(-50, 50)]), r.choice([0.5, 1.0, r.uniform(0.1, 9)])) for i, (s, k) in enumerate((s, k) for s in ("A", "B", None) for k in [None, *range(40)] for _ in range([1, 3, 12, 45][(k or 0) % 4]))]
    df = spark.createDataFrame(rows, "survey string, star long, row_id long, rv double, err double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((x.survey, x.t) for x in repeat_pairs(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _loop(rows) and len(got) > 4000


def test_nan_is_the_largest_number(spark):
    nan = math.nan
    df = spark.createDataFrame([("A", 1, 1, 3.0, 1.0), ("A", 1, 2, nan, 1.0), ("A", 1, 3, 5.0, nan), ("A", 1, 4, 6.0, nan)], "survey string, star long, row_id long, rv double, err double")
    assert sum(math.isnan(x.t) for x in repeat_pairs(df).collect()) == 2 == repeat_pairs(df).count()


def test_pairs_are_not_grouped_again(spark, sf):
    from skyloom.plans.model_queries import _valid

    plan = repeat_pairs(_valid(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
