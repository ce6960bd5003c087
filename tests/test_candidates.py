"""Candidates of objects: many pairs of few rows."""

from pyspark.sql import functions as F

from skyloom.operators.sky_join import within
from skyloom.plans.model_queries import _candidates


def test_pairs_of_small_files_are_dealt_out(spark, sf):
    tasks = _candidates(spark, sf).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 2


def test_crowded_join_is_the_plain_one(spark):
    """Poles, the seam, limits met exactly, own radii and unknown places."""
    places = [(0.0, 90.0), (10.0, -90.0), (359.9999, 0.0), (0.0001, 0.0), (10.0, 20.0), (10.0, 21.0), (13.0, 20.0), (-5.0, 3.0), (365.0, 3.0), (None, 1.0), (float("nan"), 1.0)]
    places += [((i * 137.5) % 360, (i * 37) % 179 - 89.0) for i in range(40)] + [(50.0, -30.0 + i / 3600) for i in range(5)]
    rows = [(i, ra, dec) for i, (ra, dec) in enumerate(places)]
    for radius in (1 / 3600, 3.0):
        left = spark.createDataFrame([(i, a, d, radius if i % 2 else radius / 2) for i, a, d in rows], "id long, ra double, dec double, reach double")
        right = spark.createDataFrame(rows, "r_id long, r_ra double, r_dec double")
        pairs = [sorted(map(tuple, within(left, right, radius, "reach", crowded=c).select("id", "r_id", "sep").collect())) for c in (False, True)]
        assert pairs[0] == pairs[1] and pairs[0]
