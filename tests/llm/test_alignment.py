"""Aligned tokens against a plain loop over every token, and the word cache against whole encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from skyloom.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return A.TokenPair(*PATHS)


def byte_of():
    """Letters of byte-level tokens, written out."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stay]
    return {chr(b): b for b in stay} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(pair, text):
    letters = byte_of()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    bytes_a = [bytes(letters[c] for c in pair.a.id_to_token(i)) for i in a]
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    bytes_b = [piece(pair.b.id_to_piece(i)) for i in b]
    want = (" " + text).encode()
    return (list(zip(a, bytes_a)), list(zip(b, bytes_b))) if text and b"".join(bytes_a) == want == b"".join(bytes_b) else ([], [])


def brute_groups(a, b):
    ends = lambda x: [sum(len(t) for _, t in x[: i + 1]) for i in range(len(x))]
    ends_a, ends_b = ends(a), ends(b)
    out = defaultdict(lambda: ([], []))
    cuts = sorted(set(ends_a) & set(ends_b))
    for k, (x, e) in enumerate([(a, ends_a), (b, ends_b)]):
        for (i, _), end in zip(x, e):
            out[next(c for c in cuts if c >= end)][k].append(i)
    return [out[c] for c in cuts]


def brute(pair, texts):
    groups = [brute_groups(*whole_tokens(pair, t or "")) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    count = Counter(k for x in links for k in x)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for g, x in zip(groups, links):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sums = sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g)
        out.append((*sums, sum(m for k, m in x.items() if count[k] == most[k[0]]), sum(m * count[k] for k, m in x.items()), hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return out, count, most


def rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()))


def check(pair, df, out):
    given = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert rows(out) == sorted((i is None, i or 0, *w) for (i, _), w in zip(given, brute(pair, [t for _, t in given])[0]))


STRANGE = [
    "plain words only here", "two  blanks", " leading", "trailing ", "a\nline\n\nfeed", "\nfirst", "tab\tand\x0bfeed", "it's we're I'll 12½ don't!", "<|endoftext|> and </s><s> <unk> <0x41>",
    "U+2581 ▁ itself", "▁", "é é ﬁ ǅ", "你好 世界。", "😀😀 👩‍👩‍👧", "\x00 \x01", "\xa0no-break　wide", "a" * 300, "ab" * 200, "x y", "word\nword word\nword", "\n", " ", "İ ß ſ", "\r\n a",
]


def test_words_are_encoded_as_in_whole_texts(pair, docs):
    texts = [r.text for r in docs.limit(60).collect()] + STRANGE
    for _ in range(2):
        a, b = pair.encode(texts)
        for t, x, y in zip(texts, a, b):
            assert np.frombuffer(x, pair.kind).tolist() == pair.a.encode(" " + t, add_special_tokens=False).ids, t
            assert np.frombuffer(y, pair.kind).tolist() == pair.b.encode(t), t
    small = A.TokenPair(*PATHS, most=50)
    for t in texts:
        assert small.encode([t]) == pair.encode([t])


def test_bytes_of_tokens(pair):
    letters = byte_of()
    assert pair.bytes_a[:50_256].to_pylist() == [bytes(letters[c] for c in pair.a.id_to_token(i)) for i in range(50_256)]
    assert pair.bytes_b[3:259].to_pylist() == [bytes([i]) for i in range(256)]


@pytest.mark.parametrize("most,large", [(1 << 22, 1 << 12), (7, 1 << 12), (50, 2), (1, 1)])
def test_slices(pair, most, large):
    texts = [*STRANGE, "", *STRANGE[:5]]
    sums, links = A.aligned(pair, texts, most, large)
    want, _, _ = brute(pair, texts)
    assert list(zip(*(sums[c] for c in (*A._SUMS, "groups_sha256")))) == [(*w[:4], w[6]) for w in want]
    got = {(d, k): n for d, k, n in zip(*(links[c].to_pylist() for c in ("doc", "key", "times")))}
    assert len(got) == len(links) and links["doc"].to_pylist() == sorted(links["doc"].to_pylist())
    assert got == {(d, a * pair.size_b + b): n for d, t in enumerate(texts) for (a, b), n in Counter((a, b) for x, y in brute_groups(*whole_tokens(pair, t)) for a in x for b in y).items()}


def test_query(spark, sf, docs, pair):
    check(pair, docs, A.query(spark, sf))


def test_batches_change_nothing(pair, docs):
    some = docs.limit(40)
    check(pair, some, A.align(some.repartition(3), *PATHS, slice_chars=3000, batch_chars=9000))


def test_odd_rows(spark, odd, empty, pair):
    rest = odd.filter("text IS NULL OR length(text) < 10000")
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    both = rest.unionByName(more, allowMissingColumns=True)
    check(pair, both, A.align(both, *PATHS))
    assert A.align(empty, *PATHS).count() == 0
    assert A.align(odd, *PATHS).count() == odd.count()
    clash = rest.selectExpr("doc_id", "text", "1 AS batch", "'r' AS ranks", "2 AS key", "3 AS n", "4 AS rank")
    check(pair, clash, A.align(clash, *PATHS))


def test_vocabulary_links(pair, docs):
    some = docs.limit(30)
    _, count, most = brute(pair, [r.text for r in some.collect()])
    got = {(r.a, r.b): (r["count"], r.best) for r in A.vocabulary_links(some, *PATHS).collect()}
    assert got == {k: (n, n == most[k[0]]) for k, n in count.items()}
