"""Exact copies, near copies, repeated strings and benchmark passages against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.operators.components import connected_components as components
from skyloom.llm.decontam import Items, decontaminate, search_shard, suffix_array
from skyloom.llm.exact_dedup import build_directory, exact_dedup, in_bucket, insert, probe
from skyloom.llm.repeats import anchors, remove_repeats, repeat_groups
from skyloom.llm.simhash import fingerprint, hamming_links, simhash_dedup


def lowered(text):
    return (text or "").encode("utf-8", "surrogatepass").lower()


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(a, b):
    assert sorted(a, key=key) == sorted(b, key=key)


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((i, rows[best[3]][0], len(groups[norm]), k == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_capacity": 3}, {"bucket_capacity": 2, "key_bits": 2}])
def test_exact(docs, odd, options):
    for df in (docs, odd) if not options else (odd,):
        got = exact_dedup(df, **options)
        same(rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute_exact(rows_of(df, "doc_id", "text")))
        assert got.filter("kept").count() == got.select("text_sha256").distinct().count()  # one of each group


def test_chains_and_directory(spark, odd):
    out = exact_dedup(odd, bucket_capacity=2, key_bits=2)
    assert out.agg(F.max("chain")).first()[0] > 0  # different texts under one key stay apart
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    directory, depth = build_directory(keys, 50)
    assert directory.count() == 1 << depth > 16 and directory.filter("local_depth < " + str(depth)).count() > 0
    loads = in_bucket(keys, directory, depth).groupBy("bucket", "local_depth").count().collect()
    assert sum(r["count"] for r in loads) == 1000 and max(r["count"] for r in loads) <= 50
    # a bucket that was split was overfull before
    halves = {(r.bucket, r.local_depth): r["count"] for r in loads}
    of = lambda bucket, depth: sum(n for (b, d), n in halves.items() if d >= depth and b >> (d - depth) == bucket)
    assert all(of(b >> 1, d - 1) > 50 for b, d in halves)
    # keys that differ late: deeper than the first counts
    late = spark.range(64).select((F.col("id") * (1 << 40)).alias("h"))
    directory, depth = build_directory(late.union(late), 16)
    assert depth == 20 and in_bucket(late, directory, depth).groupBy("bucket", "local_depth").count().agg(F.max("count")).first()[0] == 16


def test_the_index_is_reached_through_the_directory(spark):
    keys = spark.range(500).select("id", F.xxhash64("id").alias("h"), F.col("id").cast("string").cast("binary").alias("sha")).cache()
    directory, depth = build_directory(keys, 50)
    index = insert(keys.select("h", "sha", F.lit(1).alias("group_size")), keys.select("h", "sha", F.lit(0).alias("stays")), directory, depth)
    assert probe(keys, index, directory, depth).count() == 500
    first, other = directory.orderBy("entry").take(1)[0], directory.orderBy(F.desc("entry")).take(1)[0]
    wrong = directory.filter(F.col("entry") != first.entry).union(spark.createDataFrame([(first.entry, other.bucket, other.local_depth)], directory.schema))
    lost = 500 - probe(keys, index, wrong, depth).count()
    assert lost == keys.filter(F.shiftrightunsigned("h", 64 - depth) == first.entry).count() > 0


def brute_print(text):
    words = lowered(text).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("options", [{}, {"node_capacity": 2, "step": 5}, {"blocks": 3, "node_capacity": 7}])
def test_simhash(docs, odd, options):
    for df in (docs, odd):
        rows = rows_of(df, "doc_id", "text")
        prints = [brute_print(t) for _, t in rows]
        distinct = sorted(set(prints))
        links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2]
        of = brute_components(distinct, links)
        least = {}
        for (i, _), p in zip(rows, prints):
            if i is not None:
                least[of[p]] = min(i, least.get(of[p], i))
        same(rows_of(simhash_dedup(df, **options), "doc_id", "fingerprint", "component_id"), [(i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints)])


@pytest.mark.parametrize("capacity,blocks", [(2, None), (40, 3), (40, 4), (4096, None), (4096, 3)])
def test_links_of_close_fingerprints(spark, capacity, blocks):
    rng = np.random.default_rng(5)
    near = {int(rng.integers(1 << 62))}
    while len(near) < 300:  # a ball of close ones, and others
        x = list(near)[rng.integers(len(near))]
        near.add(x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    far = {int(x) for x in rng.integers(1 << 63, size=300)}
    values = sorted(near | far)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    labels = {r.node: r.label for r in components(hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, capacity, blocks=blocks)).collect()}
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = brute_components(signed, links)
    assert {v: labels.get(v, v) for v in signed} == want


def test_components_of_a_path(spark):
    out = components(spark.range(60).select("id", (F.col("id") + 1).alias("b")).toDF("a", "b"))
    assert out.select("label").distinct().collect()[0][0] == 0 and out.count() == 61


def brute_repeats(rows, length):
    count = defaultdict(int)
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] += 1
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"


def test_repeats(spark, docs, odd):
    for df in (docs, odd.filter("doc_id <> 10 OR doc_id IS NULL")):
        same(rows_of(remove_repeats(df), *COLUMNS), brute_repeats(rows_of(df, "doc_id", "text"), 200))


@pytest.mark.parametrize("capacity", [2, 6, 512])
def test_repeats_with_a_common_passage(spark, capacity):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(rng.choice(list("abcde "), n))
    passage, other = noise(90), noise(70)
    texts = [noise(int(rng.integers(0, 80))) + (passage if i % 3 else passage[: int(rng.integers(20, 90))] + other) + noise(int(rng.integers(0, 60))) for i in range(60)]
    texts += [noise(30) + texts[4] + noise(5), texts[5], passage * 3, "ab" * 90, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(rows_of(remove_repeats(df, length=40, gram=8, shard_capacity=capacity), *COLUMNS), brute_repeats(list(enumerate(texts)), 40))


def brute_groups(texts, length):
    """Each repeated string of distinct texts made as long as all its places agree: string -> its places."""
    places, out = defaultdict(set), {}
    for i, b in enumerate(texts):
        for s in range(len(b) - length + 1):
            places[b[s : s + length]].add((i, s))
    for at in places.values():
        if len(at) > 1:
            a = b = 0
            while all(s > a for _, s in at) and len({texts[i][s - a - 1] for i, s in at}) == 1:
                a += 1
            while all(s + length + b < len(texts[i]) for i, s in at) and len({texts[i][s + length + b] for i, s in at}) == 1:
                b += 1
            i, s = min(at)
            out[texts[i][s - a : s + length + b]] = {(i, s - a) for i, s in at}
    return out


@pytest.mark.parametrize("capacity", [2, 6, 512])
def test_repeat_groups(spark, capacity):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    long, short, tail = noise(300), noise(50), noise(33)
    texts = [noise(9) + long + noise(7), long[100:] + noise(20), noise(5) + long[100:200], *(noise(int(k)) + short + noise(11) for k in rng.integers(0, 30, 9)), *(noise(3) + short[10:] + tail for _ in range(4)), tail, "xy" * 40, noise(39)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, texts[1]), (91, texts[1]), (92, noise(6)), (93, noise(6)), (None, None), (94, "")]
    got = repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=8, shard_capacity=capacity).collect()
    raws = [t.encode() for t in texts]
    want = brute_groups(raws, 40)
    groups = defaultdict(set)
    for r in got:
        if r.group.startswith("text-"):
            assert (r.doc_id, r.copies, r.n, r.start, r.size) == (1, 3, 1, 0, len(raws[1]))
        else:
            assert r.copies == (3 if r.doc_id == 1 else 1)
            groups[r.group].add((raws[r.doc_id][r.start : r.start + r.size], r.n, r.doc_id, r.start))
    found = {}
    for rows in groups.values():
        (w,) = {x[0] for x in rows}
        assert {x[1] for x in rows} == {len(rows)} and w not in found
        found[w] = {x[2:] for x in rows}
    assert found == want
    assert sum(r.group.startswith("text-") for r in got) == 1


def test_repeat_groups_of_odd_rows(spark, docs, odd, empty):
    assert repeat_groups(empty).count() == 0
    for df in (docs, odd.filter("doc_id <> 10 OR doc_id IS NULL")):
        texts = dict(df.filter("doc_id IS NOT NULL").select("doc_id", "text").collect())
        marks, groups = defaultdict(set), defaultdict(set)
        for r in repeat_groups(df).collect():
            groups[r.group].add((texts[r.doc_id] or "").encode()[r.start : r.start + r.size])
            marks[r.doc_id] |= set(range(r.start, r.start + r.size))
        assert all(len(x) == 1 and len(next(iter(x))) >= 200 for x in groups.values())
        removed = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
        assert all(len(at) == removed[i] for i, at in marks.items())


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([(20, 4), (33, 8), (8, 8)]))
def test_anchors_cover_every_string(raw, sizes):
    length, gram = sizes
    place, _, first, last = anchors(raw, length, gram)
    starts = [s for a, b in zip(first.tolist(), last.tolist()) for s in range(a, b + 1)]
    assert starts == list(range(max(0, len(raw) - length + 1)))
    assert all(b <= p and p + gram <= a + length for p, a, b in zip(place, first, last))


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(rows, tests):
    windows = defaultdict(set)
    for item, t in tests:
        w = words(t)
        n = min(13, len(w))
        if w and item is not None:
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for s in range(len(w)):
            for n in sizes:
                if s + n <= len(w) and (found := windows.get(tuple(w[s : s + n]))):
                    hit |= set(range(s, s + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_decontamination(spark, docs, odd, sf, block):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("item_id", F.col("item_id").cast("string"))
    more = spark.createDataFrame([("p", "quick brown fox"), ("q", "the lazy dog and then it runs home again to sleep all day the"), (None, "a"), ("r", None), ("s", "..."), ("t", "Same text here")], "item_id string, text string")
    tests = bench.unionByName(more)
    for df in (docs, odd):
        got = decontaminate(df, tests, block_chars=block)
        same(rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute_hits(rows_of(df, "doc_id", "text"), rows_of(tests, "item_id", "text")))
    assert decontaminate(odd, tests.limit(0)).filter("contaminated").isEmpty()


def test_longest_match_and_suffix_array():
    assert suffix_array(np.array([2, 1, 2, 1, 1]), 5).tolist() == [4, 3, 1, 2, 0]
    out = search_shard(["x y a b c d e z", "b c d"], Items([("i", "a b c d e"), ("j", "b c d")], 3))
    assert out[0][3] == (5, 2, "i") and out[1][3] == (3, 0, "i") and out[0][2] == ["i", "j"]


def test_long_item_is_kept_in_linear_space():
    tests = Items([("i", "a b c " * 40_000)], 13)
    assert {len(w) for w in tests.windows} == {4 * 13} and len(tests.windows) == 3
    out = search_shard(["z " + "b c a " * 20_000 + "z", "a b c"], tests)
    assert len(out[0][1]) == 60_000 and out[0][3][:2] == (60_000, 1) and not len(out[1][1])


def test_longest_match_is_the_same_in_blocks(spark):
    docs = spark.createDataFrame([(1, "x a b c d y e f g h"), (2, "e f g h a b c d"), (3, "q"), (4, None)], "doc_id long, text string")
    tests = spark.createDataFrame([("i", "a b c d"), ("j", "e f g h"), ("k", "e f g h"), ("l", "c d")], "item_id string, text string")
    for block in (4 << 20, 5):
        got = decontaminate(docs, tests, window=3, block_chars=block)
        assert sorted(map(tuple, got.select("doc_id", "longest_match", "longest_at", "longest_item").collect())) == [(1, 4, 1, "i"), (2, 4, 0, "j"), (3, 0, None, None), (4, 0, None, None)]


def test_empty_tables(spark, empty):
    tests = spark.createDataFrame([], "item_id long, text string")
    for df in (exact_dedup(empty), simhash_dedup(empty), remove_repeats(empty), decontaminate(empty, tests)):
        assert df.count() == 0


def test_fingerprint_in_slices():
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    assert fingerprint(text) == fingerprint(text, slice_size=7) == brute_print(text)
