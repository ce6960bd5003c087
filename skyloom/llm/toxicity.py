"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, documents, id_bucket, mapped
from .linear import adam, bounded_sample, grouped_sum

_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    """Sentences of a text, split after . ! ? and at line ends; an empty text has one empty sentence."""
    return [s for s in _SENTENCE.split(text) if s.strip()] or [""]


def features(word: str) -> tuple[int, ...]:
    """A word and its beginnings, as 32-bit hashes: insults of one stem have many endings."""
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in (word, *("^" + word[:k] for k in range(5, 9) if len(word) > k)))


def noisy_or_gradient(w: np.ndarray, b: float, column: np.ndarray, sentence_of: np.ndarray, doc_of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the documents' mean log loss by the weights and the bias. column and sentence_of: features and the
    sentences they are in; doc_of: the document of each sentence; y: the documents' labels."""
    n, n_s = len(y), len(doc_of)
    p = 1 / (1 + np.exp(-np.clip(grouped_sum(w[column], sentence_of, n_s) + b, -30, 30)))
    clean = np.exp(grouped_sum(np.log1p(-np.minimum(p, 1 - 1e-9)), doc_of, n))
    pull = np.where(y > 0.5, -clean / np.maximum(1 - clean, 1e-9), 1.0)
    g = p * pull[doc_of] / n
    return grouped_sum(g[sentence_of], column, len(w)), float(g.sum())


def fit(rows: Iterable[tuple[str, int]], min_docs: int = 4, steps: int = 250, shrink: float = 1e-4) -> tuple[dict[int, float], float]:
    """Weights of features and a bias from (text, label) rows: a sentence's score is the logistic of its distinct
    features' weights, a document's 1 - prod(1 - score). The loss is the documents' log loss plus an L1 penalty."""
    bags, sizes, docs, y = [], [], [], []
    for text, label in rows:
        own = [np.fromiter(set().union(*map(features, set(_WORD.findall(s.lower())))), np.uint32) for s in sentences(text)]
        sizes += [len(b) for b in own]
        docs.append(len(own))
        bags.append(np.concatenate(own))
        y.append(label)
    if not y:
        return {}, -3.0
    y, n, n_s = np.array(y, float), len(y), len(sizes)
    # a feature can speak for toxicity only if it stands in enough documents
    vocabulary, seen = np.unique(np.concatenate([np.unique(b) for b in bags]), return_counts=True)
    vocabulary = vocabulary[seen >= min_docs]
    flat = np.concatenate(bags)
    del bags
    at = np.searchsorted(vocabulary, flat)
    known = np.zeros(len(flat), bool) if not len(vocabulary) else vocabulary[np.minimum(at, len(vocabulary) - 1)] == flat
    column = at[known].astype(np.int32)
    sentence_of = np.repeat(np.arange(n_s, dtype=np.int32), sizes)[known]
    doc_of = np.repeat(np.arange(n, dtype=np.int32), docs)
    n_w = max(1, len(vocabulary))
    del flat, at, known

    def gradient(w, b):
        g_w, g_b = noisy_or_gradient(w, b[0], column, sentence_of, doc_of, y)
        return g_w + shrink * np.sign(w), np.array([g_b])

    w, b = adam([np.zeros(n_w), np.array([-5.0])], gradient, steps, 0.08)
    return {int(vocabulary[i]): float(w[i]) for i in np.flatnonzero(np.abs(w) > 0.1) if i < len(vocabulary)}, float(b[0])


class Scorer:
    def __init__(self, weights: dict[int, float], bias: float, most: int = 200_000):
        self.weights, self.bias, self.most = weights, bias, most
        self.known: dict[str, tuple[int, ...]] = {}  # what counts of a word; of most words, nothing

    def _look(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= self.most:
            self.known.clear()
        out = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return out

    def score(self, text: str) -> tuple[float, list[float]]:
        """Noisy-or of the sentence scores, and the scores."""
        z, get, weights = [], self.known.get, self.weights
        for s in sentences(text):
            own: set[int] = set()
            for w in set(_WORD.findall(s.lower())):
                if f := self._look(w) if (f := get(w)) is None else f:
                    own.update(f)
            z.append(sum(weights[f] for f in sorted(own)))
        p = 1 / (1 + np.exp(-np.clip(np.array(z) + self.bias, -30, 30)))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p.tolist()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_fold: int = 2, threshold: float = 0.3, max_per_label: int = 2000, max_fit_chars: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, worst_sentence (its number), n_flagged.

    The model is fitted on at most about max_per_label labelled documents of each label, outside the held
    fold, none over max_fit_chars; these two bound what reaches the driver. Scoring reads every whole text.
    Null text counts as empty and has the score of one empty sentence; a null doc_id is in fold
    crc32('') mod folds. Labels that are null, or rows of labels for no document, teach nothing; repeated
    labels count once each. Without labels every score is the bias alone. An empty table gives an empty result.
    """
    rows = chosen(docs, id_col, text_col).withColumn("fold", id_bucket("doc_id", folds))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    taught = rows.filter(F.col("fold") != held_fold).join(known, "doc_id").select("doc_id", "text", "label")
    weights, bias = fit((r.text, r.label) for r in bounded_sample(taught, "label", max_per_label, max_fit_chars).select("text", "label").toLocalIterator())

    def run(batches):
        scorer = Scorer(weights, bias)
        for pdf in batches:
            out = []
            for t in pdf.text:
                s, each = scorer.score(t)
                out.append((s, int(s >= threshold), int(np.argmax(each)), sum(p >= threshold for p in each)))
            out = pd.DataFrame(out, columns=["score", "predicted", "worst_sentence", "n_flagged"])
            out.insert(0, "held_out", pdf.fold.to_numpy() == held_fold)
            out.insert(0, "doc_id", pdf.doc_id.to_numpy())
            yield out

    return mapped(rows, run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int, worst_sentence int, n_flagged int")


def query(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
