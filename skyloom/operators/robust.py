"""Means that resist outliers, per group.

Each is two aggregations joined by key: both combine before the shuffle, and a join on a hot key is split
by adaptive execution, so no large group is ever gathered in one task as a window would. Medians of large groups are those of
`quantiles`, which never gathers one either; lists of outliers and of texts are the result itself. NaN and
infinities count as unknown, as null does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..storage import stored
from .quantiles import large_groups, parted, refined

SCALE = 1.4826


def inverse_variance(value: Column, error: Column) -> tuple[Column, Column]:
    """Weighted mean and its error over rows whose value and positive error are known."""
    value, error = finite(value), finite(error)
    w = F.when(value.isNotNull() & (error > 0), 1 / (error * error))
    return F.sum(w * value) / F.sum(w), 1 / F.sqrt(F.sum(w))


def clipped_weighted_mean(df: DataFrame, keys: list[str], value: str, error: str, sigma: float = 3.0) -> DataFrame:
    """One rejection pass at sigma times each row's own error. No known error: plain mean without error.
    One measurement: itself. All rejected: plain mean and population deviation, none listed.
    Returns keys, n, mean, err, n_outliers, outliers (sorted)."""
    v, e = F.col(value), F.col(error)
    known = df.withColumns({value: finite(v), error: finite(e)}).filter(v.isNotNull())
    ok = e.isNotNull() & (e > 0)
    w = F.when(ok, 1 / (e * e))
    first = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(v).alias("_avg"), F.stddev_pop(v).alias("_std"), F.count(F.when(ok, 1)).alias("_ne"), (F.sum(w * v) / F.sum(w)).alias("_wm"))
    flagged = known.join(first.select(*keys, "_wm"), keys).withColumn("_out", ok & (F.abs(v - F.col("_wm")) > sigma * e))
    inside = ok & ~F.col("_out")
    w_in = F.when(inside, 1 / (e * e))
    second = flagged.groupBy(*keys).agg(
        F.count(F.when(inside, 1)).alias("_in"), (F.sum(w_in * v) / F.sum(w_in)).alias("_m"), (1 / F.sqrt(F.sum(w_in))).alias("_e"), F.sort_array(F.collect_list(F.when(F.col("_out"), v))).alias("_o"), F.max(F.when(ok, e)).alias("_e1")
    )
    some = (F.col("_ne") > 1) & (F.col("_in") > 0)
    return first.join(second, keys).select(
        *keys,
        F.col("_n").alias("n"),
        F.when(some, F.col("_m")).when(F.col("_ne") == 1, F.when(F.col("_n") == 1, F.col("_avg")).otherwise(F.col("_m"))).otherwise(F.col("_avg")).alias("mean"),
        F.when(some | (F.col("_ne") == 1), F.col("_e")).when(F.col("_ne") > 1, F.col("_std")).alias("err"),
        F.when(some, F.size("_o")).otherwise(0).alias("n_outliers"),
        F.when(some, F.col("_o")).otherwise(F.array().cast("array<double>")).alias("outliers"),
    )


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    return 0.5 * F.get(ordered, F.shiftright(n - 1, 1)) + 0.5 * F.get(ordered, F.shiftright(n, 1))


def _counted_out(rows: DataFrame, by: list[str], keys: list[str], scale: float) -> DataFrame:
    """median_mad of large groups: keys, n, median, mad by counts in cells."""
    med = refined(rows, by, {"median": 0.5})
    far = rows.join(med.select(*by, "median"), by).select(*by, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    return med.join(refined(far, by, {"mad": 0.5}).drop("n"), by).select(*keys, "n", "median", (scale * F.col("mad")).alias("mad"))


def median_mad(df: DataFrame, keys: list[str], value: str, scale: float = 1.0, whole_rows: int = 1 << 20, small: int = 1 << 16, keep: bool = True) -> DataFrame:
    """keys, n, median, mad (times scale), exact for groups of any size; groups of a null key are left out. A group of at most `small` rows
    (any group, if there are at most whole_rows in all) is one sorted array, from which both come; larger ones are counted in cells.
    keep: whether the values are written once instead of being made again for each pass, as suits all but what is read from a table."""
    by = [*keys, "_g"]
    known = df.select(*keys, F.lit(0).alias("_g"), finite(F.col(value).cast("double")).alias("_v")).filter(F.col("_v").isNotNull()).dropna(subset=by)
    known = stored(known, "values") if keep else known
    large, all_large = large_groups(known, by, small, whole_rows)
    whole, cut = (known, None) if large is None else (None, known) if all_large else parted(known, large, by)
    if whole is None:
        return _counted_out(cut, by, keys, scale)
    arrays = whole.repartition(*by).groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_s")).withColumn("median", _middle(F.col("_s")))
    away = arrays.withColumn("_away", F.sort_array(F.transform("_s", lambda x: F.abs(x - F.col("median")))))
    out = away.select(*keys, F.size("_s").cast("long").alias("n"), "median", (scale * _middle(F.col("_away"))).alias("mad"))
    return out if cut is None else out.union(_counted_out(cut, by, keys, scale))


def mad_clipped_mean(df: DataFrame, keys: list[str], value: str, sigma: float = 3.0) -> DataFrame:
    """Mean of values within sigma scaled MADs of the median; the plain mean if the MAD is 0 or none is within.
    Returns keys, n, mean, n_outliers."""
    spread = median_mad(df, keys, value, SCALE)
    inside = F.abs(F.col(value) - F.col("median")) <= sigma * F.col("mad")
    out = df.withColumn(value, finite(F.col(value))).filter(F.col(value).isNotNull()).join(spread.select(*keys, "median", "mad"), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_all"), F.avg(F.when(inside, F.col(value))).alias("_in"), F.count(F.when(~inside, 1)).alias("_out"), F.max("mad").alias("_mad"))
    clip = (F.col("_mad") > 0) & F.col("_in").isNotNull()
    return out.select(*keys, "n", F.when(clip, F.col("_in")).otherwise(F.col("_all")).alias("mean"), F.when(clip, F.col("_out")).otherwise(0).alias("n_outliers"))


def first_known(pairs: list[tuple[Column, Column | None, float]]) -> tuple[Column, Column]:
    """Value and error of the first pair whose value is known, times its unit."""
    value = F.coalesce(*(v * f for v, _, f in pairs))
    err = F.lit(None).cast("double")
    for v, e, f in reversed(pairs):
        err = F.when(v.isNotNull(), (e * f) if e is not None else F.lit(None).cast("double")).otherwise(err)
    return value, err


def stacked(df: DataFrame, keys: list[str], pairs: list[tuple[str, str, float]]) -> DataFrame:
    """One row for each known value among several (value, error) columns."""
    items = F.array(*(F.struct((F.col(v) * f).alias("value"), (F.col(e) * f).alias("error"), F.lit(v).alias("source")) for v, e, f in pairs))
    return df.select(*keys, F.inline(items)).filter("value IS NOT NULL")


def joined_text(column: Column) -> Column:
    """Sorted distinct trimmed texts, comma-joined; blanks and nan left out."""
    t = F.trim(column)
    return F.array_join(F.array_sort(F.collect_set(F.when((t != "") & (F.lower(t) != "nan"), t))), ",")


def joined_ids(columns: list[str]) -> Column:
    """'column:id' of sorted distinct ids, columns in the given order, joined by '; '."""
    def named(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_set(F.col(c).cast("long"))), lambda x: F.concat(F.lit(c + ":"), x.cast("string")))

    parts = [named(c) for c in columns]
    return F.array_join(F.concat(*parts), "; ")


def mean_error_and_scatter(df: DataFrame, keys: list[str], value: str, error: str) -> DataFrame:
    """keys, n, mean, d = 1/sqrt(sum w), s2 = sum w (v - mean)^2 / ((n - 1) sum w) for groups of two and more.
    The sums of w, wv and wvv give both in one aggregation; values are taken from the group's first to keep digits."""
    w = 1 / (F.col(error) * F.col(error))
    known = df.withColumns({c: finite(F.col(c)) for c in (value, error)}).filter(F.col(value).isNotNull() & (F.col(error) > 0))
    m = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), F.sum(w).alias("_w")).filter("n >= 2")
    s = known.join(m.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(w * F.pow(F.col(value) - F.col("mean"), 2)).alias("_s"))
    return m.join(s, keys).select(*keys, "n", "mean", (1 / F.sqrt("_w")).alias("d"), (F.col("_s") / ((F.col("n") - 1) * F.col("_w"))).alias("s2"))


def weighted_covariance(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted means and 2 x 2 covariance per group; rows with any unknown value are left out."""
    known = df.withColumns({c: finite(F.col(c)) for c in (x, y, w)}).filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(w).isNotNull())
    s = F.sum(w)
    m = known.groupBy(*keys).agg((F.sum(F.col(w) * F.col(x)) / s).alias("mx"), (F.sum(F.col(w) * F.col(y)) / s).alias("my"))
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    c = known.join(m, keys).groupBy(*keys).agg(*((F.sum(F.col(w) * a * b) / s).alias(n) for n, a, b in (("xx", dx, dx), ("xy", dx, dy), ("yy", dy, dy))))
    return m.join(c, keys)


def mean_position(df: DataFrame, keys: list[str], ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Mean direction of a group by the sum of unit vectors, right across the 0/360 seam: keys, ra, dec."""
    from ..functions.sky import unit_vector

    x, y, z = unit_vector(F.col(ra), F.col(dec))
    s = df.groupBy(*keys).agg(F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(z).alias("_z"))
    return s.select(*keys, F.pmod(F.degrees(F.atan2("_y", "_x")), F.lit(360.0)).alias("ra"), F.degrees(F.atan2(F.col("_z"), F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))).alias("dec"))


def first_array(df: DataFrame, keys: list[str], array: str, order: str) -> DataFrame:
    """The first array that is not null and not all null."""
    given = F.col(array).isNotNull() & F.exists(array, lambda v: v.isNotNull())
    return df.filter(given).groupBy(*keys).agg(F.min_by(array, order).alias(array))
