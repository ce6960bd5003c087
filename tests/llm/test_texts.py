"""Licences, models, packing and the pipeline."""

import functools
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import langid, licenses, packing, ppm, quality, toxicity

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_base(docs, odd):
    for df in (docs, odd):
        for r, t in zip(licenses.license_scan(df).collect(), [x.text for x in df.select("text").collect()]):
            w, starts, labels = word_list(t), [], set()
            for phrase, label in BASE.items():
                p = phrase.split()
                for s in range(len(w)):
                    if w[s : s + len(p)] == p:
                        starts.append(s)
                        labels.add(label)
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
            assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_expressions():
    assert licenses.parse("( mit or apache-2.0 ) and gpl-2.0 with cp".split()) == ["mit", "apache-2.0", "or", "gpl-2.0", "cp", "with", "and"]
    assert licenses.parse(["mit", "or"]) is None and licenses.parse(["(", "mit"]) is None and licenses.parse(["mit", ")"]) is None
    assert licenses.evaluate(["mit", "gpl-3.0-only", "or"]) == ({"mit", "gpl"}, 0.95)
    assert licenses.evaluate(["mit", "gpl-3.0-only", "and"])[1] == 0.35
    assert licenses.evaluate(["gpl-2.0", "classpath", "with"])[1] == pytest.approx(0.675)
    row = licenses.scan("SPDX-License-Identifier: LGPL-2.1 OR MIT and this is prose", *licenses._automata())
    assert row[5] == "lgpl,mit"


def big(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 2500"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_toxicity_held_out(spark, odd, empty):
    docs, labels = big(spark)
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count()
    held = out.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    wrong = (held.predicted != held.toxic).mean()
    assert wrong < 0.03, wrong
    assert toxicity.toxicity(odd, labels).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count() and toxicity.toxicity(empty, labels).count() == 0
    flags = {r.doc_id: r.held_out for r in out.collect()}
    assert all(v == (fold(k, 4) == 2) for k, v in flags.items())


def test_toxic_sentence_is_found():
    rows = [(f"plain words number {i}. nothing here {i}", 0) for i in range(40)] + [(f"plain words number {i}. you foul thing {i}. end", 1) for i in range(40)]
    weights, bias = toxicity.fit(rows)
    scorer = toxicity.Scorer(weights, bias, 2)
    score, each = scorer.score("plain words. a foul thing. end")
    assert score > 0.3 and int(np.argmax(each)) == 1 and scorer.score("plain words. end")[0] < 0.3


def test_quality_held_out(spark, odd, empty):
    docs, labels = big(spark)
    grades = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    held = quality.quality(docs, grades).filter("held_out").join(labels, "doc_id").select("selected", "quality", "expected_grade").toPandas()
    assert (held.selected == (held.quality == 1)).mean() > 0.9
    assert quality.quality(odd, grades).filter("expected_grade BETWEEN 0 AND 2").count() == odd.count()
    assert quality.quality(empty, grades.limit(0)).count() == 0


def test_thresholds_are_ordered():
    rows = [("bad " * 5, 0), ("fair " * 5, 1), ("good " * 5, 2)] * 20
    w, cuts = quality.fit(rows, 3, 1 << 10)
    grade = [1 / (1 + np.exp(-(w[quality.features(t, 1 << 10, {})].mean() - cuts))) for t in ("bad", "fair", "good")]
    assert cuts[0] < cuts[1] and [int(g.sum().round()) for g in grade] == [0, 1, 2]


def test_language(spark, odd, empty):
    docs, _ = big(spark)
    out = langid.language_id(docs)
    held = out.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97
    got = {r.doc_id: r for r in langid.language_id(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[8].lang_pred != "und"
    assert langid.language_id(empty).count() == 0
    assert {r.lang_pred for r in langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bloom_counts():
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(1 << 32, size=4000, dtype=np.uint64).astype(np.uint32))
    mask = np.where(np.arange(len(gram)) % 2, 1, 3).astype(np.uint64)
    f = langid.Filters.build(["a", "b"], gram.astype(np.int64), mask)
    assert f.counts(gram)[0] == pytest.approx(len(gram), rel=1e-3) and f.counts(gram)[1] == pytest.approx((mask == 3).sum(), rel=0.02)
    other = rng.integers(1 << 32, size=4000, dtype=np.uint64).astype(np.uint32)
    assert f.counts(other).max() < 40


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def tokens_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(docs, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    for df, window in ((docs, 4096), (odd, 64)):
        pieces = packing.pack(df, path, window=window).toPandas()
        by_doc = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            by_doc[r.doc_id].append(tokens_of(r.text))
        total = sum(len(x) for v in by_doc.values() for x in v)
        assert pieces.length.sum() == total and (pieces.length > 0).all()
        for _, g in pieces.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        sizes = pieces.groupby("sequence_id").length.sum()
        assert (sizes.iloc[:-1] == window).all() and sizes.iloc[-1] <= window and len(sizes) == -(-total // window)
        if df is docs:
            for d, g in pieces.sort_values("start").groupby("doc_id"):
                ids, at = by_doc[d][0], 0
                for r in g.itertuples():
                    assert r.start == at and r.doc_tokens == len(ids)
                    at += r.length
                    assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
                assert at == len(ids)
            mixture = pieces.merge(df.select("doc_id", "source").toPandas(), on="doc_id")
            share = mixture.groupby("source").length.sum() / total
            full = mixture[mixture.sequence_id < mixture.sequence_id.max()]
            for (_, s), n in full.groupby(["sequence_id", "source"]).length.sum().items():
                assert abs(n - share[s] * window) < 2
    assert packing.pack(empty, path).count() == 0


def test_word_tokens_equal_the_tokenizer(docs, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordTokens(path, most=500)
    texts = [r.text or "" for r in docs.union(odd.select(docs.columns)).select("text").collect()]
    texts += ["".join(chr(c) for c in range(a, a + 40)) for a in range(0, 0x500, 40)] + ["It's we'll 'S'VE a'b ''re x́ Å"]
    for i in range(0, len(texts), 50):
        for t, got in zip(texts[i : i + 50], encoder.encode(texts[i : i + 50])):
            assert np.frombuffer(got, encoder.kind).tolist() == tokens_of(t)[:-1]


def brute_base(rows):
    train = [t for i, t in rows if fold(i, 10) != 0]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(x for t in train for x in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(i, fold(i, 10) == 0, len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, sum(log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in rows]


def test_lm_base_and_score(docs, odd, empty):
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in ppm.lm_score(df).collect()), key=order)
        want = sorted(brute_base([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]), key=order)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    out = ppm.lm_score(docs).filter("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert 1 < out < 3.5
    assert ppm.lm_score(empty).count() == 0


def brute_ppm(texts, raw):
    c = defaultdict(Counter)
    for t in texts:
        p = b"\0\0" + t
        for i in range(2, len(p)):
            c[p[i - 2 : i]][p[i]] += 1
    for k in [k for k in c if len(k) == 2]:
        for s, n in c[k].items():
            c[k[1:]][s] += n
            c[b""][s] += n
    total, p = 0.0, b"\0\0" + raw
    for i in range(2, len(p)):
        ps, left, gone = np.zeros(256), 1.0, set()
        for k in (p[i - 2 : i], p[i - 1 : i], b""):
            live = {s: n for s, n in c.get(k, {}).items() if s not in gone}
            if live:
                d = sum(live.values()) + len(live)
                for s, n in live.items():
                    ps[s] = left * n / d
                left *= len(live) / d
                gone |= set(live)
        for s in set(range(256)) - gone:
            ps[s] = left / (256 - len(gone))
        total += log10(ps[p[i]] / ps.sum())
    return total


def test_trie_against_brute_force():
    texts = [b"abracadabra", b"banana band", b"", bytes(range(30)), b"abra abra"]
    trie = ppm.Trie(*ppm.trigrams(texts))
    for t in (b"abra", b"", b"zebra\xff\x00", b"banana band" * 3):
        assert trie.score([b"x", t])[1] == pytest.approx(brute_ppm(texts, t), rel=1e-5, abs=1e-9)
    p = 10.0 ** trie.table.astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert ppm.adaptive_score(b"ab" * 100) > ppm.adaptive_score(bytes(range(200)))


def test_pipeline(spark, sf, docs, odd, empty):
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        seen = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in seen.collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) < len(rows)
    from tests.llm.test_copies import brute_hits

    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(h[5] for h in brute_hits([(i, rows[i]) for i in kept], tests))
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert set(pieces.doc_id) == kept and pieces.length.sum() == sum(len(tokens_of(rows[i])) for i in kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    odd_pieces = corpus_pipeline.packed(spark, odd, sf).toPandas()
    assert odd_pieces.length.sum() == sum(len(tokens_of(r.text)) for r in odd.collect())
    hits = brute_hits([(i, r.text) for i, r in enumerate(odd.collect())], tests)
    assert corpus_pipeline.decontaminated(spark, odd, sf).count() == sum(not h[5] for h in hits)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("SPDX-License-Identifier: WTFPL", "wtfpl"), ("SPDX-License-Identifier: OpenSSL", "openssl"), ("// SPDX-License-Identifier: Some-Thing", "some-thing"), ("SPDX-License-Identifier: MIT+", "mit"),
        ("License: MIT/Apache-2.0", "apache,mit"), ("BSD 3-Clause License", "bsd"), ("SPDX-License-Identifier: GPL-2.0+ OR Odd AND Other", "gpl,odd,other"), ("license: see the file", ""),
        ("SPDX-License-Identifier: BUSL-1.1", "busl"), ("SPDX-License-Identifier: Strange-1.1-or-later", "strange"), ("license: Strange-1.1", "strange"), ("İSPDX-License-Identifier: LGPL-2.1 OR MIT and this is prose", "lgpl,mit"),
    ],
)
def test_license_tags(text, labels):
    assert licenses.scan(text, *licenses._automata())[5] == labels


def test_license_of_empty_table(empty):
    assert licenses.license_scan(empty).count() == 0


def test_numerals_are_no_letters(spark):
    taught = [(i, f"der die das und {i} nicht" if i % 2 else f"the and that {i} with not", "de" if i % 2 else "en") for i in range(300)]
    odd = ["½ ²³", "① ② ③", "Ⅷ", "²", "12 _", "", None, "ª", "中", "ǅ", "½ x"]
    df = spark.createDataFrame(taught + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r.doc_id - 1000: (r.lang_pred, r.score) for r in langid.language_id(df).filter("doc_id >= 1000").collect()}
    assert all(got[i] == ("und", 0.0) for i in range(7)) and all(got[i][0] in ("de", "en") for i in range(7, 11))
    with pytest.raises(ValueError, match="max_filter_mb"):
        langid.fit(df.filter("lang IS NOT NULL"), max_filter_mb=0)
