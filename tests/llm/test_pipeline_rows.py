"""Stages of the pipeline decide by row where ids are null or repeated."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(stage, df, spark, sf):
    return Counter((r.doc_id, r.text) for r in stage(spark, df, sf).collect())


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_language_and_exact_on_odd_rows(spark, sf, odd):
    rows = rows_of(odd)
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert kept(cp.language, odd, spark, sf) == Counter(letters)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r[1] or "")].append(r)
    got = kept(cp.exact, odd, spark, sf)
    want = {min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()}
    assert got == Counter(want)


def test_rows_without_id_do_not_bring_each_other_back(spark, sf):
    long = " ".join(f"word{i}" for i in range(300))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, "A clean text of its own."), (None, "12 34 ..."), (None, long), (None, long.replace(" ", "  ")), (7, long + "\n"), (7, "another text with id seven"), (None, item)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert (None, "12 34 ...") not in kept(cp.language, df, spark, sf)
    exact = kept(cp.exact, df, spark, sf)
    assert [r for r in exact if r[1].startswith("word0")] == [(None, long.replace(" ", "  "))] and sum(exact.values()) == 5
    near = kept(cp.near, df, spark, sf)
    assert [r for r in near if r[1].startswith("word0")] == [(7, long + "\n")] and (7, "another text with id seven") in near
    bare = df.filter("doc_id IS NULL")
    assert len([r for r in kept(cp.near, bare, spark, sf) if r[1].startswith("word0")]) == 1
    clean = kept(cp.decontaminated, df, spark, sf)
    assert (None, item) not in clean and (None, "A clean text of its own.") in clean and sum(clean.values()) == 6
