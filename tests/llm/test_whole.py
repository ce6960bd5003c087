"""Text operators on inputs that a bounded model, class count or queue count would cut short."""

from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import pytest

from skyloom.llm import langid, ppm


def brute_order(texts, raw, order):
    c = defaultdict(Counter)
    for t in texts:
        p = b"\0" * order + t
        for i in range(order, len(p)):
            for k in range(order + 1):
                c[p[i - k : i]][p[i]] += 1
    total, p = 0.0, b"\0" * order + raw
    for i in range(order, len(p)):
        left, gone = 1.0, set()
        for k in range(order, -1, -1):
            live = {s: n for s, n in c.get(p[i - k : i], {}).items() if s not in gone}
            d = sum(live.values()) + len(live)
            if p[i] in live:
                total += log10(left * live[p[i]] / d)
                break
            left *= len(live) / d if live else 1.0
            gone |= set(live)
        else:
            total += log10(left / (256 - len(gone)))
    return total


@pytest.mark.parametrize("order", [1, 2, 4, 6])
def test_score_of_any_order(spark, order):
    texts = ["abracadabra", "banana band", "", "abra abra cadabra", "über straße", "zebra\x01 über", None, "the bananas abracadabra", "qqq"]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: crc32(str(i).encode()) % 3 == 0
    taught = [(t or "").encode() for i, t in rows if not held(i)]
    assert 0 < len(taught) < len(rows)
    got = {r.doc_id: r.score for r in ppm.lm_score(df, folds=3, order=order).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(brute_order(taught, (t or "").encode(), order), rel=1e-9, abs=1e-9)


def test_score_learns_more_than_three_bytes(spark):
    # after "a-b-" comes c or d as the fourth byte back tells, which two context bytes cannot see
    text = "xa-b-c ya-b-d " * 200
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    bits = lambda order: ppm.lm_score(df, order=order).first().bits_per_byte
    assert bits(5) < 0.5 * bits(2)


def test_more_than_64_languages(spark):
    # 100 languages, the later ones rarer: each has words of its own
    words = lambda k: [f"{a}{chr(97 + k % 26)}{b}{chr(97 + k // 26)}{a}" for a in "bcdfg" for b in "aeiou"]
    rows = [(1000 * k + i, " ".join(words(k)[i % 5 :] * 3), f"l{k:03}") for k in range(100) for i in range(40 if k < 70 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.language_id(df).toPandas().merge(df.toPandas(), on="doc_id")
    assert out.lang_pred.nunique() == 100 and (out.lang == out.lang_pred).mean() > 0.99


def test_all_grams_of_the_sample_are_kept(spark):
    # 12,000 words, each once: more n-grams than the former 6,000 of a language
    word = lambda i, a: a + "".join(chr(97 + i // 26**j % 26) for j in range(3)) + a
    rows = [(k, " ".join(word(i, a) for i in range(12_000)), lang) for k, (lang, a) in enumerate([("a", "q"), ("b", "x")])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_fit_chars=1 << 20)
    for _, text, lang in rows:
        got = model.counts(langid.grams(text))[model.languages.index(lang)]
        assert got == pytest.approx(len(langid.grams(text)), rel=0.01)
