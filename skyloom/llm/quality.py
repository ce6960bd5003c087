"""Quality by ordinal cumulative-link regression: shared hashed-text weights, ordered thresholds."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, documents, id_bucket, mapped
from .linear import adam, bounded_sample, grouped_sum

_RUN = re.compile(r"[^\W\d_]+|\d+")


def _buckets(token: str, dims: int) -> tuple[int, ...]:
    """Hashed features of a token: itself in lower case, and its shape (letters to a, digits to 9)."""
    low = token.lower()
    shape = _RUN.sub(lambda m: "9" if m[0].isdigit() else "a", low)
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % (dims - 1) for x in ("w " + low, "s " + shape))


def features(text: str, dims: int, cache: dict, most: int = 200_000) -> np.ndarray:
    """Bucket numbers of all tokens of a text; the last bucket counts tokens that repeat the one before."""
    out, before = [], None
    for t in text.split():
        if (b := cache.get(t)) is None:
            if len(cache) >= most:
                cache.clear()
            b = cache[t] = _buckets(t, dims)
        out += b
        if t == before:
            out.append(dims - 1)
        before = t
    return np.array(out, np.int64)


def link_gradient(w: np.ndarray, first: float, gaps: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient of the mean negative log likelihood of the grades y by the weights, the first threshold and the
    logarithms of the gaps between thresholds. row, col, value: the features of the texts."""
    n, grades = len(y), len(gaps) + 2
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    t = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
    eta = grouped_sum(w[col] * value, row, n)
    upper = np.c_[np.ones(n), logistic(eta[:, None] - t), np.zeros(n)]  # P(grade >= k), k = 0..K
    at = np.arange(n)
    hi, lo = upper[at, y], upper[at, y + 1]
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g_eta = -(d_hi - d_lo) / n
    g_t = np.zeros(grades - 1)
    np.add.at(g_t, np.maximum(y - 1, 0), np.where(y > 0, d_hi, 0) / n)
    np.add.at(g_t, np.minimum(y, grades - 2), np.where(y < grades - 1, -d_lo, 0) / n)
    return grouped_sum(g_eta[row] * value, col, len(w)), float(g_t.sum()), np.array([g_t[i + 1 :].sum() for i in range(grades - 2)]) * np.exp(gaps)


def fit(rows: list[tuple[str, int]], grades: int, dims: int, steps: int = 300, shrink: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds t_1 < ... < t_(K-1) of P(grade >= k) = logistic(mean weight - t_k)."""
    cache: dict = {}
    bags = [np.unique(features(t, dims, cache), return_counts=True) for t, _ in rows]
    y, n = np.array([g for _, g in rows], np.int64), len(rows)
    if not n:
        return np.zeros(dims), np.arange(grades - 1.0)
    col = np.concatenate([b for b, _ in bags])
    row = np.repeat(np.arange(n), [len(b) for b, _ in bags])
    value = np.concatenate([c / max(1, c.sum()) for _, c in bags])

    def gradient(w, first, gaps):
        g_w, g_first, g_gaps = link_gradient(w, first[0], gaps, row, col, value, y)
        return g_w + shrink * w, np.array([g_first]), g_gaps

    w, first, gaps = adam([np.zeros(dims), np.array([-1.0]), np.zeros(grades - 2)], gradient, steps, 0.1)
    return w, first[0] + np.r_[0.0, np.cumsum(np.exp(gaps))]


def quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, tail: int = 1, select_at: float = 0.5, dims: int = 1 << 15, folds: int = 4, held_fold: int = 2, max_per_grade: int = 2500, max_fit_chars: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, held_out, expected_grade, tail_prob = P(grade >= tail), selected.

    Grades are 0 .. grades - 1; other or null ones teach nothing. The fit takes at most about max_per_grade
    rated documents of each grade, none over max_fit_chars, outside the held fold. Scoring reads every whole
    text; null or empty text has no features and is judged by the thresholds alone. Rows map one to one; an
    empty table gives an empty result. A tail probability of just select_at is selected.
    """
    rows = chosen(docs, id_col, text_col).withColumn("fold", id_bucket("doc_id", folds))
    known = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).filter(F.col("grade").between(0, grades - 1))
    taught = rows.filter(F.col("fold") != held_fold).join(known, "doc_id").select("doc_id", "text", "grade")
    sample = bounded_sample(taught, "grade", max_per_grade, max_fit_chars).select("text", "grade")
    weights, cuts = fit([(r.text, r.grade) for r in sample.toLocalIterator()], grades, dims)

    def run(batches):
        cache: dict = {}
        for pdf in batches:
            eta = np.array([weights[f].mean() if len(f := features(t, dims, cache)) else 0.0 for t in pdf.text])
            p = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts, -30, 30)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.fold == held_fold, "expected_grade": p.sum(axis=1), "tail_prob": p[:, tail - 1], "selected": p[:, tail - 1] >= select_at})

    return mapped(rows, run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, expected_grade double, tail_prob double, selected boolean")


def query(spark, sf_dir):
    """Ratings from two labels: 0 low quality, 1 good but toxic, 2 good and clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(documents(spark, sf_dir), labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade")))
