"""Names by any of their forms, with names in many rows."""

import threading

from skyloom.functions.text import name_variants
from skyloom.operators import keyed_join

NAMES = ["NGC 104", "NGC_104", "ngc104", "M 4", "m_4", "M4", "###", "", None, "Pal 5"]


def test_against_loops(spark):
    left = spark.createDataFrame([(i, v) for i, v in enumerate([*NAMES, "PAL_5", "Other", "NGC 104"])], "id int, n string")
    right = spark.createDataFrame([(v,) for v in [*NAMES, "M4", "M4"]], "m string")
    forms = {r.n: [(f.priority, f.name) for f in r.f] for r in left.select("n", name_variants(left.n).alias("f")).collect()}
    want = {}
    for i, n in ((r.id, r.n) for r in left.collect()):
        hits = [(p, q, m) for p, a in forms[n] for m in NAMES for q, b in forms[m] if a and a == b]
        want[i] = min(hits)[2] if hits else None
    assert {r.id: r.matched_name for r in keyed_join.by_name(left, right, "n", "m", per_task=3).collect()} == want


def test_copies_make_no_pairs(spark):
    """Thirty thousand copies of a name on either side: as pairs they are 900 million."""
    left, right = spark.range(30_000).selectExpr("id", "'NGC_104' AS n"), spark.range(30_000).selectExpr("'ngc 104' AS m")
    limit = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        out = keyed_join.by_name(left, right, "n", "m")
        assert out.filter("matched_name = 'ngc 104'").count() == 30_000
    finally:
        limit.cancel()
