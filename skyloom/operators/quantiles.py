"""Exact quantiles of groups of any size.

Spark's own percentile keeps every distinct value of a group in one task. Here the values are counted in cells, fine ones of the logarithm
first, which combine before the shuffle; the cell that holds the wanted rank is cut into finer ones, until what is
left in it is few rows, or one value. Groups that are few rows as a whole are counted out first and left to Spark's own
percentile: cells of many small groups would be as many as their rows. No task ever holds a large group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..storage import discard, stored

SUB = 4096


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Join on columns, null keys being equal; columns of right are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    on = functools.reduce(lambda a, b: a & b, (left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in columns))
    return left.join(renamed, on).drop(*(f"_r_{c}" for c in columns))


def _log_cell(v: Column) -> Column:
    """Cells that follow the order of v, 256 an octave on either side of 0."""
    size = F.floor(F.log2(F.abs(v)) * 256) + 300_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")


def _found(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """cells(keys, _parent, _cell, _n, _lo, _hi) in which the ranks of wanted(keys, _parent, _name, _k, _before) fall: wanted
    with the cell's own columns, _before being the group's rows before the cell."""
    own = Window.partitionBy(*keys, "_parent").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    hit = _same(ahead, wanted, [*keys, "_parent"]).withColumn("_before", F.col("_before") + F.col("_ahead"))
    return hit.filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n"))).drop("_ahead")


def large_groups(rows: DataFrame, by: list[str], small: int, whole_rows: int) -> tuple[DataFrame | None, bool]:
    """Stored keys of the groups of more than `small` rows, at most a small-th of the rows, and whether all groups are such; None if there are
    none, or no more than whole_rows rows in all. One pass over the rows."""
    seen = Observation()
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.observe(seen, F.sum("_n").alias("rows"), F.count(F.when(F.col("_n") <= small, 1)).alias("small"))
    large = stored(sizes.filter(F.col("_n") > small).select(*by), "large-groups")
    if (seen.get["rows"] or 0) <= whole_rows or large.isEmpty():
        discard(large)
        return None, False
    return large, not seen.get["small"]


def parted(rows: DataFrame, large: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows of the groups that are not in `large`, and of those that are; null keys being equal."""
    on = functools.reduce(lambda a, b: a & b, (rows[c].eqNullSafe(large[c]) for c in by))
    return rows.join(large, on, "left_anti"), rows.join(large, on, "left_semi")


def _percentiles(rows: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", F.array(*(F.lit(float(p)) for p in probs.values()))).alias("_q"))
    return out.select(*by, "n", *(F.col("_q")[i].alias(name) for i, name in enumerate(probs)))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], whole_rows: int = 1 << 20, few: int = 1 << 16, n_rows: int | None = None, small: int = 1 << 16) -> DataFrame:
    """keys, n and a column for each named share: exact quantiles, linear between ranks, of the values that are neither
    null nor NaN nor infinite; groups without values give no row, no keys mean one group. At most whole_rows
    rows are left to Spark's percentile, and so are groups of at most `small` rows, which changes nothing but speed; n_rows, their number
    or more, saves the counting. `few` bounds what one task sorts at the end."""
    keys = list(keys)
    by = [*keys, "_g"]
    v = finite(F.col(value).cast("double"))
    rows = df.select(*keys, F.lit(0).alias("_g"), v.alias("_v")).filter("_v IS NOT NULL")
    if n_rows is not None and n_rows <= whole_rows:
        return _percentiles(rows, by, probs).drop("_g")
    rows = stored(rows, "values")  # once, as what they come of may be long
    large, all_large = large_groups(rows, by, small, whole_rows)
    if large is None:
        return _percentiles(rows, by, probs).drop("_g")
    if all_large:
        return refined(rows, by, probs, few).drop("_g")
    whole, cut = parted(rows, large, by)
    return _percentiles(whole, by, probs).union(refined(cut, by, probs, few)).drop("_g")


def refined(rows: DataFrame, by: list[str], probs: dict[str, float], few: int = 1 << 16) -> DataFrame:
    """by, n and the quantiles of _v, by counts in cells and no group in one place."""
    made = []
    counts = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]  # of a cell
    rows = rows.withColumns({"_parent": F.lit(0).cast("long"), "_cell": _log_cell(F.col("_v"))})
    cells = stored(rows.groupBy(*by, "_parent", "_cell").agg(*counts), "cells")
    made.append(cells)
    sizes = cells.groupBy(*by).agg(F.sum("_n").alias("n"))
    ranks = [F.struct(F.lit(name).alias("_name"), F.lit(up).alias("_up"), (F.ceil if up else F.floor)((F.col("n") - 1) * float(p)).cast("long").alias("_k"), ((F.col("n") - 1) * float(p) % 1).alias("_part")) for name, p in probs.items() for up in (0, 1)]
    wanted = sizes.select(*by, "n", F.inline(F.array(*ranks))).withColumns({"_parent": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")})
    hit, answers = stored(_found(cells, wanted, by), "ranks"), None
    made.append(hit)
    names = [*by, "n", "_name", "_up", "_part"]
    while True:
        one = hit.filter("_lo = _hi").select(*names, F.col("_lo").alias("_answer"))
        answers = one if answers is None else answers.union(one)
        left = hit.filter("_lo < _hi")
        most = left.agg(F.max("_n")).first()[0]
        if most is None:
            break
        spans = left.select(*by, "_cell", "_lo", "_hi").distinct()
        inside = _same(rows.select(*by, "_cell", "_v"), spans, [*by, "_cell"])
        wanted = left.select(*names, "_k", "_before", F.col("_cell").alias("_parent"))
        if most <= few:
            values = inside.groupBy(*by, F.col("_cell").alias("_parent"), F.col("_v").alias("_cell")).agg(*counts)
            last = _found(values, wanted, by)
            answers = answers.union(last.select(*names, F.col("_lo").alias("_answer")))
            break
        sub = F.least(F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / SUB)), F.lit(SUB - 1))
        # numbers of the cells of a level: those of the one before are few, so they are dealt anew
        rows = stored(inside.select(*by, F.col("_cell").alias("_parent"), (F.pmod(F.xxhash64("_cell"), F.lit(1 << 48)) * SUB + sub).alias("_cell"), "_v"), "inside")
        hit = stored(_found(rows.groupBy(*by, "_parent", "_cell").agg(*counts), wanted, by), "ranks")
        made += [rows, hit]
    value_of = lambda name, up: F.max(F.when((F.col("_name") == name) & (F.col("_up") == up), F.col("_answer")))
    part_of = lambda name: F.max(F.when(F.col("_name") == name, F.col("_part")))
    out = answers.groupBy(*by).agg(F.max("n").alias("n"), *((value_of(name, 0) * (1 - part_of(name)) + value_of(name, 1) * part_of(name)).alias(name) for name in probs))
    out = stored(out.select(*by, "n", *probs), "quantiles")
    discard(*made)
    return out


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median", **bounds: int | None) -> DataFrame:
    """keys, n and the median of each group."""
    return quantiles(df, keys, value, {name: 0.5}, **bounds)
