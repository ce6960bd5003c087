"""Places in a total order, without a task that holds all rows or a whole group.

Rows are dealt out by ranges of the order and sorted there; a row's place is its place in its range and the number of
rows in the ranges before it. Only the ranges' row counts are summed up in one place, a row a range and group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_RANGE = 33  # monotonically_increasing_id has the partition above this bit and the row in it below


def numbered(rows: DataFrame, order: list, by: list[str] | None = None, name: str = "position", parts: int | None = None) -> DataFrame:
    """rows and their place from 0 in `order`, or, where `by` is given, within each group of equal (or null) `by` columns.

    Rows that are equal in `by` and `order` stand in the order they are read in, which also parts them among ranges: neither
    a group nor a tie of any size lands in one task. Null orders come first unless the order says otherwise. An
    empty table gives an empty result."""
    by = list(by or [])
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    at = [*by, *order, "_tie"]
    kept = stored(keyed.repartitionByRange(parts, *at).sortWithinPartitions(*at).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    kept = kept.withColumn("_range", F.shiftright("_at", _RANGE))
    sizes = stored(kept.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "range-sizes")
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(c).alias(f"_s_{c}") for c in by), F.col("_range").alias("_s_range"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on: list[Column] = [kept[c].eqNullSafe(F.col(f"_s_{c}")) for c in by] + [F.col("_range") == F.col("_s_range")]
    out = kept.join(starts, functools.reduce(lambda a, b: a & b, on))
    return out.select(*(f"`{c}`" for c in rows.columns), (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: list, right_order: list, name: str = "position") -> DataFrame:
    """The two tables side by side: the first row of one with the first of the other, and so on. The longer one's
    further rows have nulls beside them. Column names must differ."""
    a, b = numbered(left, left_order, name=name), numbered(right, right_order, name=name)
    return a.join(b, name, "full_outer")
