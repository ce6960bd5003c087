"""Bounded samples of labelled rows, and bags of word ids for models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def bounded_sample(rows: DataFrame, strata: str, per_stratum: int, max_chars: int) -> DataFrame:
    """About per_stratum rows of each value of strata, however many values, chosen by a hash of id and text; whole
    texts, of which those over max_chars are left out, as are null values. A share by hash, so no task gathers a
    stratum."""
    fit = rows.filter(F.col(strata).isNotNull() & (F.length("text") <= max_chars))
    share = F.least(F.lit(1.0), per_stratum / F.count(F.lit(1)))
    # stored, so that Spark sees how small it is and never shuffles the texts for it
    takes = stored(fit.groupBy(strata).agg((share * (1 << 30)).cast("long").alias("_take")), "strata")
    # the largest share is a number, which Spark can hold against texts before it joins them with their labels
    draw, most = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)), takes.agg(F.max("_take")).first()[0] or 0
    return fit.filter(draw < most).join(takes, strata).filter(draw < F.col("_take")).select(*rows.columns)


def adam(params: list[np.ndarray], gradient, steps: int, rate: float) -> list[np.ndarray]:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(*params), m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return params


def grouped_sum(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, n)
