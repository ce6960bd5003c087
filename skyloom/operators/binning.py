"""Binned statistics, histograms and threshold sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bin_half_open, bin_last_closed, bin_open_low
from ..storage import stored
from .quantiles import medians, quantiles


def percentile_range(df: DataFrame, value: str, low: float, high: float, keys: list[str] = ()) -> DataFrame:
    """Exact percentiles, linear between ranks, as lo and hi."""
    return quantiles(df, keys, value, {"lo": low, "hi": high}).drop("n")


def percentile_clip(df: DataFrame, value: str, keys: list[str], low: float = 0.01, high: float = 0.99, least: int = 3) -> DataFrame:
    """Rows within the group's percentiles; groups of fewer than `least` rows stay whole."""
    span = quantiles(df, keys, value, {"_lo": low, "_hi": high}).withColumnRenamed("n", "_n")
    return df.join(span, keys).filter((F.col("_n") < least) | F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_n")


def binned_median(df: DataFrame, keys: list[str], x: str, y: str, n_bins: int | Column, least: int = 10) -> DataFrame:
    """Equal bins [lo, hi) of x over its p1..p99 of each group; bins of at least `least` rows:
    keys, bin, centre, n, median, mad. n_bins may be an expression of the group's row count _n."""
    n_bins = n_bins if isinstance(n_bins, Column) else F.lit(n_bins)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = quantiles(known, keys, x, {"_lo": 0.01, "_hi": 0.99}).withColumnRenamed("n", "_n").filter((F.col("_n") >= 2 * least) & (F.col("_hi") > F.col("_lo")))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    binned = known.join(span, keys).filter((F.col(x) >= F.col("_lo")) & (F.col(x) < F.col("_hi"))).withColumn("bin", F.least(F.floor((F.col(x) - F.col("_lo")) / width), n_bins - 1))
    by = [*keys, "bin"]
    centre = (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("centre")
    binned = stored(binned.select(*by, y, centre), "binned")
    med = medians(binned, by, y).filter(F.col("n") >= least).join(binned.groupBy(*by).agg(F.first("centre").alias("centre")), by)
    away = binned.join(med.select(*by, "median"), by).withColumn("_away", F.abs(F.col(y) - F.col("median")))
    return med.join(medians(away, by, "_away", "mad").drop("n"), by)


def histogram(df: DataFrame, value: str, low: float, high: float, n: int, keys: list[str] = (), density: bool = False) -> DataFrame:
    """keys, bin, count (or density): the last bin is closed."""
    out = df.withColumn("bin", bin_last_closed(F.col(value), low, high, n)).filter("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    if not density:
        return out
    total = out.groupBy(*keys).agg(F.sum("count").alias("_t")) if keys else out.agg(F.sum("count").alias("_t"))
    # one row for each group: a key join, or one number
    out = out.join(total, list(keys)) if keys else out.withColumn("_t", F.lit(total.first()[0]))
    return out.select(*keys, "bin", (F.col("count") / (F.col("_t") * ((high - low) / n))).alias("density"))


def histogram_2d(df: DataFrame, x: str, y: str, x_bins: tuple, y_bins: tuple, more: dict[str, Column] | None = None) -> DataFrame:
    """Counts, and further aggregates, of (bx, by) cells."""
    out = df.withColumns({"bx": bin_last_closed(F.col(x), *x_bins), "by": bin_last_closed(F.col(y), *y_bins)}).filter("bx IS NOT NULL AND by IS NOT NULL")
    return out.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("count"), *(c.alias(n) for n, c in (more or {}).items()))


def binned_mean(df: DataFrame, x: str, value: str, low: float, high: float, n: int) -> DataFrame:
    """Mean per bin (lo, hi], ends held."""
    return df.filter(F.col(x).isNotNull() & F.col(value).isNotNull()).withColumn("bin", bin_open_low(F.col(x), low, high, n)).groupBy("bin").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).withColumn("mean", F.col("total") / F.col("n"))


def profile(df: DataFrame, x: str, score: str, low: float, high: float, n: int, high_score: float = 0.8, least: int = 10) -> DataFrame:
    """Count, mean, share above high_score and median per bin [lo, hi), of bins with `least` rows."""
    out = df.withColumn("bin", bin_half_open(F.col(x), low, high, n)).filter("bin IS NOT NULL")
    sums = out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.avg((F.col(score) > high_score).cast("double")).alias("share_high")).filter(F.col("n") >= least)
    return sums.join(medians(out, ["bin"], score).drop("n"), "bin", "left")


def sweep(df: DataFrame, metric: str, score: str, cuts: list[float], by: list[str] = ()) -> DataFrame:
    """For each cut the rows with metric < cut: count, retention, mean score and share of all score.

    A row adds to the first cut above its metric only; running sums over the few cuts give the rest, so the
    rows are neither copied for each cut nor read again."""
    first = F.lit(None).cast("int")
    for i in range(len(cuts) - 1, -1, -1):
        first = F.when(F.col(metric) < float(cuts[i]), i).otherwise(first)
    part = df.withColumn("_k", F.coalesce(first, F.lit(len(cuts)))).groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_s"))
    grid = df.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(cuts)], "_k int, cut double")
    if by:
        grid = part.select(*by).distinct().select(*by, F.inline(F.array(*(F.struct(F.lit(i).alias("_k"), F.lit(float(c)).alias("cut")) for i, c in enumerate(cuts)))))
        totals = part.groupBy(*by).agg(F.sum("_n").alias("_all_n"), F.sum("_s").alias("_all_s"))
        cells = grid.join(part, [*by, "_k"], "left").join(totals, list(by))
    else:
        total = part.agg(F.sum("_n"), F.sum("_s")).first()
        cells = grid.join(part, "_k", "left").withColumns({"_all_n": F.lit(total[0]), "_all_s": F.lit(total[1])})
    upto = Window.partitionBy(*by, F.lit(0)).orderBy("_k")
    n, s = F.coalesce(F.sum("_n").over(upto), F.lit(0)), F.coalesce(F.sum("_s").over(upto), F.lit(0.0))
    cells = cells.withColumns({"n": n, "_cum": s})
    return cells.select(*by, "cut", "n", (F.col("n") / F.col("_all_n")).alias("retention"), F.try_divide("_cum", "n").alias("mean_score"), F.try_divide("_cum", "_all_s").alias("score_share"))


def precision_recall(df: DataFrame, score: str, n: int = 101) -> DataFrame:
    """Selections score >= t for n thresholds from 0 to 1: threshold, precision (mean score), recall (share of
    the score captured), and area: the trapezoid to the next row. An empty selection has precision 1, recall 0."""
    cuts = [i / (n - 1) for i in range(n)]
    k = F.floor(F.col(score) * (n - 1) + 1e-9).cast("int")
    part = df.filter(F.col(score).isNotNull()).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum(score).alias("s"))
    grid = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cuts)], "k int, threshold double").join(part, "k", "left")
    above, everything = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")), Window.partitionBy(F.lit(0))
    out = grid.withColumns({"c": F.coalesce(F.sum("c").over(above), F.lit(0)), "t": F.coalesce(F.sum("s").over(above), F.lit(0.0)), "all": F.sum("s").over(everything)})
    out = out.select("k", "threshold", F.when(F.col("c") > 0, F.col("t") / F.col("c")).otherwise(1.0).alias("precision"), F.when(F.col("c") > 0, F.try_divide("t", "all")).otherwise(0.0).alias("recall"))
    after = Window.partitionBy(F.lit(0)).orderBy("k")
    return out.withColumn("area", F.coalesce((F.col("recall") - F.lead("recall").over(after)) * (F.col("precision") + F.lead("precision").over(after)) / 2, F.lit(0.0)))


def cumulative(df: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """Running sum over a table of bins."""
    return df.withColumn("cumulative", F.sum(value).over(Window.partitionBy(*by, F.lit(0)).orderBy(order)))


def smallest_groups_out(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    return df.join(df.groupBy(*keys).count().filter(F.col("count") >= least).select(*keys), keys, "left_semi")


def clipped_binned_median(df: DataFrame, x: str, y: str, edges: list[float], least: int = 5, top: float = 0.98) -> DataFrame:
    """Median of y per bin [edge, edge) of x, values above the bin's `top` percentile left out first; bins of fewer
    than `least` rows go: bin, n, median."""
    k = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        k = F.when((F.col(x) >= edges[i]) & (F.col(x) < edges[i + 1]), i).otherwise(k)
    rows = df.withColumn("bin", k).filter(F.col("bin").isNotNull() & F.col(y).isNotNull())
    span = quantiles(rows, ["bin"], y, {"_top": top}).filter(F.col("n") >= least)
    kept = medians(rows.join(span, "bin").filter(F.col(y) <= F.col("_top")), ["bin"], y).filter("n >= 2").drop("n")
    return span.select("bin", "n").join(kept, "bin")


def density_curve(df: DataFrame, value: str, low: float, high: float, points: int, bandwidth: float, n_bins: int = 512) -> DataFrame:
    """Gaussian kernel density at `points` places of low..high: x, density. Rows are counted in n_bins bins far
    narrower than the bandwidth, so what meets the grid is bounded."""
    width = (high - low) / n_bins
    bins = df.filter(F.col(value).between(low, high)).groupBy(F.least(F.floor((F.col(value) - low) / width), F.lit(n_bins - 1)).alias("b")).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("n"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * ((high - low) / (points - 1)))
    one = bins.withColumn("x", F.explode(grid)).withColumn("u", (F.col("x") - F.col("v")) / bandwidth)
    sums = one.groupBy("x").agg(F.sum(F.col("n") * F.exp(-0.5 * F.col("u") * F.col("u"))).alias("s"), F.sum("n").alias("t"))
    return sums.select("x", (F.col("s") / (F.col("t") * (bandwidth * 2.5066282746310002))).alias("density"))


def axis_range(df: DataFrame, values: list[str], reference: float | None = None, positive: bool = False) -> DataFrame:
    """One row, lo and hi: p1 and p99 over several columns, widened to hold a reference."""
    rows = df.select(F.explode(F.array(*values)).alias("v")).filter("v IS NOT NULL" + (" AND v > 0" if positive else ""))
    out = quantiles(rows, [], "v", {"lo": 0.01, "hi": 0.99}).drop("n")
    return out if reference is None else out.select(F.least("lo", F.lit(float(reference))).alias("lo"), F.greatest("hi", F.lit(float(reference))).alias("hi"))


def recovery_map(df: DataFrame, x: str, y: str, recovered: str, x_bins: tuple, y_bins: tuple) -> DataFrame:
    """Injected and recovered rows and their ratio per cell: completeness where the truth is known."""
    cells = histogram_2d(df, x, y, x_bins, y_bins, {"n_recovered": F.count(F.when(F.col(recovered), 1))})
    return cells.select("bx", "by", F.col("count").alias("n_injected"), "n_recovered", (F.col("n_recovered") / F.col("count")).alias("completeness"))


def smoothed_map(cells: DataFrame, value: str, nx: int, ny: int, sigma: float = 3.0, truncate: float = 4.0) -> DataFrame:
    """cells(bx, by, value) of a map of nx x ny cells, smoothed by a Gaussian of sigma cells: bx, by, value for every cell. Cells not
    given are 0, the map is mirrored at its borders, the kernel ends at truncate sigmas. One axis after the other."""
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = [(k, w / sum(weights)) for k, w in zip(range(-reach, reach + 1), weights)]
    spark = cells.sparkSession
    now = cells.groupBy("bx", "by").agg(F.sum(value).alias("v"))
    grid = spark.range(nx * ny).select(F.expr(f"id div {ny}").alias("bx"), (F.col("id") % ny).alias("by"))
    for axis, n in (("bx", nx), ("by", ny)):
        mirrored = lambda i, n=n: F.when((i % (2 * n) + 2 * n) % (2 * n) < n, (i % (2 * n) + 2 * n) % (2 * n)).otherwise(2 * n - 1 - (i % (2 * n) + 2 * n) % (2 * n))
        taken = grid.select("bx", "by", F.inline(F.array(*(F.struct(mirrored(F.col(axis) + k).alias("s"), F.lit(w).alias("w")) for k, w in kernel))))
        other = "by" if axis == "bx" else "bx"
        source = now.select(F.col(axis).alias("s"), F.col(other).alias("o"), "v")
        joined = taken.join(source, (taken["s"] == source["s"]) & (taken[other] == source["o"]), "left")
        now = joined.groupBy("bx", "by").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return now.withColumnRenamed("v", value)


def contour_levels(cells: DataFrame, value: str, n: int = 5, low: float = 0.2, high: float = 0.95) -> DataFrame:
    """One row, level_0 .. level_{n-1}: the values of a map's cells above 0 at n shares from low to high."""
    shares = {f"level_{i}": low + (high - low) * i / (n - 1) for i in range(n)}
    return quantiles(cells.filter(F.col(value) > 0), [], value, shares).drop("n")
