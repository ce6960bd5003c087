"""The fitted operators against plain loops, and inputs beyond what their first versions cut off."""

import math
import time

import numpy as np
import pytest

from skyloom.llm import langid, licenses, quality, toxicity
from skyloom.llm.linear import bounded_sample


def labels_of(text):
    return licenses.scan(text, *licenses._automata())[5]


def test_license_expressions_of_any_length():
    line = "SPDX-License-Identifier: " + " AND ".join(["Apache-2.0"] * 80) + " AND GPL-3.0-only"
    assert len(line) > 1000 and labels_of(line) == "apache,gpl" and labels_of(line + "\nAND MIT") == "apache,gpl"
    assert labels_of("license: (mit and (gpl-2.0") == "" and labels_of("license: mit and (gpl-2.0 or isc) and") == "gpl,isc,mit"
    assert labels_of("license: mit) or gpl-2.0") == "mit" and labels_of("license: or mit") == "" and labels_of("license:") == ""
    began = time.time()
    assert labels_of("license: " + "(" * 200_000 + "mit" + ")" * 200_000) == "mit"
    assert labels_of("license: " + " or ".join(["mit"] * 100_000) + " or (gpl-2.0") == "mit"
    assert time.time() - began < 20


def brute_longest(tokens):
    for m in range(len(tokens), 0, -1):
        if (p := licenses.parse(tokens[:m])) is not None:
            return p
    return None


def test_longest_expression_is_that_of_all_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(600):
        tokens = rng.choice(["mit", "gpl-2.0", "and", "or", "with", "(", ")"], int(rng.integers(1, 9))).tolist()
        assert licenses.longest_valid(" ".join(tokens)) == brute_longest(tokens)


def test_sample_takes_any_number_of_strata(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text", "concat('k', id) AS k").union(spark.sql("SELECT 1L, 't', CAST(NULL AS STRING)"))
    got = bounded_sample(df, "k", 10, 100)
    assert got.count() == 5000 and got.columns == df.columns
    many = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "id % 2 AS k")
    assert 1500 < bounded_sample(many, "k", 1000, 100).count() < 2500


def test_noisy_or_score_is_that_of_a_loop():
    weights = {f: 0.7 for f in toxicity.features("foul")} | {f: -0.4 for f in toxicity.features("kind")} | {f: 2.0 for f in toxicity.features("insulting")}
    scorer = toxicity.Scorer(weights, -2.0)
    for text in ("A foul foul day. Kind words! insulting\n\ninsult", "", "...", "plain"):
        clean, each = 1.0, []
        for s in toxicity.sentences(text):
            z = -2.0
            for f in {f for w in "".join(c if c.isalpha() else " " for c in s.lower()).split() for f in toxicity.features(w)}:
                z += weights.get(f, 0.0)
            each.append(1 / (1 + math.exp(-z)))
            clean *= 1 - each[-1]
        score, got = scorer.score(text)
        assert score == pytest.approx(1 - clean) and got == pytest.approx(each)


def test_noisy_or_gradient_is_that_of_differences():
    rng = np.random.default_rng(1)
    n_w, n_s, n = 6, 12, 5
    doc_of = np.sort(np.r_[np.arange(n), rng.integers(0, n, n_s - n)])
    sentence_of = np.sort(rng.integers(0, n_s, 30))
    column, y, w, b = rng.integers(0, n_w, 30), np.array([1, 0, 1, 0, 1.0]), rng.normal(size=n_w), -0.5

    def loss(w, b):
        total = 0.0
        for d in range(n):
            clean = 1.0
            for s in np.flatnonzero(doc_of == d):
                clean *= 1 - 1 / (1 + math.exp(-(w[column[sentence_of == s]].sum() + b)))
            total -= math.log(1 - clean if y[d] else clean)
        return total / n

    g_w, g_b = toxicity.noisy_or_gradient(w, b, column, sentence_of, doc_of, y)
    e = 1e-6
    assert g_w == pytest.approx([(loss(w + e * k, b) - loss(w - e * k, b)) / (2 * e) for k in np.eye(n_w)], abs=1e-6)
    assert g_b == pytest.approx((loss(w, b + e) - loss(w, b - e)) / (2 * e), abs=1e-6)


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_cumulative_link_gradient_is_that_of_differences(grades):
    rng = np.random.default_rng(grades)
    n, dims = 20, 7
    row, col, value, y = np.repeat(np.arange(n), 4), rng.integers(0, dims, 4 * n), rng.uniform(0, 1, 4 * n), rng.integers(0, grades, n)
    params = np.r_[rng.normal(size=dims), -0.7, rng.normal(size=grades - 2) * 0.3]

    def loss(x):
        w, t = x[:dims], [x[dims]]
        for g in x[dims + 1 :]:
            t.append(t[-1] + math.exp(g))
        total = 0.0
        for i in range(n):
            eta = sum(w[c] * v for c, v in zip(col[row == i], value[row == i]))
            above = [1.0, *(1 / (1 + math.exp(-(eta - c))) for c in t), 0.0]
            total -= math.log(above[y[i]] - above[y[i] + 1])
        return total / n

    g_w, g_first, g_gaps = quality.link_gradient(params[:dims], params[dims], params[dims + 1 :], row, col, value, y)
    e = 1e-6
    assert np.r_[g_w, g_first, g_gaps] == pytest.approx([(loss(params + e * k) - loss(params - e * k)) / (2 * e) for k in np.eye(len(params))], abs=1e-6)


def test_language_counts_are_those_of_sets(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect() if r.text and r.lang]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = {lang: set(np.concatenate([langid.grams(t) for _, t, l in rows if l == lang]).tolist()) for lang in model.languages}
    for text in [*(t for _, t, _ in rows[:40]), "qzx wqj xxyy", "Ünï"]:
        g = langid.grams(text)
        true = [sum(x in known[lang] for x in g.tolist()) for lang in model.languages]
        assert model.counts(g) == pytest.approx(true, abs=max(4.0, 0.04 * len(g)))


def test_letters_without_a_known_gram(spark):
    rows = [(i, "the words of one language", "en") for i in range(9)] + [(i, "die worte einer sprache", "de") for i in range(9, 18)] + [(99, "漢字仮名", None), (100, "12 -- 34", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[99] == ("de", 0.0) and got[100] == ("und", 0.0)
