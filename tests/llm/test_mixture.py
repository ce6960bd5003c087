"""Packing's mixture against a deficit round-robin of single windows, dry queues, and many sources."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from skyloom.llm import packing


def brute_round_robin(sizes, weights, window):
    """Tokens of each queue in each window: quotas are added up, whole tokens taken, the rest carried."""
    left, out, deficit, tokens = dict(sizes), [], defaultdict(Fraction), sum(sizes.values())
    while tokens:
        room, got = min(window, tokens), defaultdict(int)
        while room:
            live = {q: Fraction(weights[q]) for q, n in left.items() if n and weights[q] > 0} or {q: Fraction(n) for q, n in left.items() if n}
            # until a queue is dry or the window is full, at the shares of those that are not
            span = min(Fraction(room), *(left[q] * sum(live.values()) / w for q, w in live.items())) if live else 0
            part = max(1, int(span))
            for q, w in live.items():
                deficit[q] += part * w / sum(live.values())
            for _ in range(part):
                q = max((q for q in live if left[q]), key=lambda q: (deficit[q], q))
                deficit[q] -= 1
                left[q] -= 1
                got[q] += 1
            room -= part
        out.append(got)
        tokens = sum(left.values())
    return out


@pytest.mark.parametrize("sizes, weights", [
    ((700, 90, 4000), (700, 90, 4000)), ((1000, 1, 1000), (1000, 1, 1000)), ((3,), (1,)), ((500, 500, 500), (0.5, 0.3, 0.2)),
    ((2000, 30, 400), (0.1, 0.6, 0.3)), ((100, 0, 77), (0, 1, 1)), ((64, 64), (0.5, 0.5)), ((5, 3000), (0.9, 0.0)),
])
def test_windows_are_those_of_a_deficit_round_robin(sizes, weights):
    window = 64
    sizes, weights = dict(enumerate(sizes)), dict(enumerate(weights))
    of_queue = packing.phases(sizes, weights)
    rng, total = np.random.default_rng(3), sum(sizes.values())
    taken, spans = defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for q, n in sizes.items():
        at = 0
        while at < n:  # documents of the queue
            size = min(n - at, int(rng.integers(1, 150)))
            place = 0
            for start, length, w, offset in packing.pieces(at, size, of_queue[q], window):
                assert start == place and length > 0
                place += length
                taken[w][q] += length
                spans[w].append((offset, length))
            assert place == size
            at += size
    for w, found in spans.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == min(window, total - w * window)
    want = brute_round_robin(sizes, weights, window)
    assert len(want) == len(taken) == -(-total // window)
    for q in sizes:  # what a queue has put in so far, within the rounding of a phase
        got, best = np.cumsum([taken[w][q] for w in range(len(want))]), np.cumsum([w[q] for w in want])
        assert np.abs(got - best).max() <= 2 + len(sizes)


def tokens_by_window(pieces, df):
    return pieces.merge(df.toPandas()[["doc_id", "source"]], on="doc_id").groupby(["sequence_id", "source"], dropna=False).length.sum()


def test_target_shares_and_dry_queues(spark):
    import public_tokenizers

    rows = [(i, "plain words of a text " * (3 + i % 5), ["a", "b", "c", None][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), window=256, shares={"a": 0.5, "b": 0.25}).toPandas()
    found = tokens_by_window(out, df)
    full = out.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == 256).all()
    dry = out.merge(df.toPandas()[["doc_id", "source"]], on="doc_id").query("source == 'a'").sequence_id.max()
    for w in range(dry):
        assert abs(found[w, "a"] - 128) <= 2 and abs(found[w, "b"] - 64) <= 2
    assert abs(found[dry + 1, "b"] - 128) <= 2  # b takes over half of what a leaves


def test_thousands_of_sources_are_spread(spark):
    import public_tokenizers

    rows = [(i, "some words of a document here " * (1 + i % 3), "hot" if i % 3 == 0 else f"s{i % 3001}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), window=1024).toPandas()
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.max()).all() and out.doc_id.nunique() == 12_000
    sizes = out.groupby("sequence_id").length.sum()
    assert (sizes.iloc[:-1] == 1024).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    found = tokens_by_window(out, df)
    hot = found.xs("hot", level="source")
    share = hot.sum() / out.length.sum()
    assert (abs(hot.iloc[:-1] - share * 1024) <= 2).all()
    # a small source's documents lie apart over all windows, not next to each other
    at = out.merge(df.toPandas()[["doc_id", "source"]], on="doc_id").query("source != 'hot'").groupby("source").sequence_id.agg(["min", "max"])
    last = out.sequence_id.max()
    assert (at["max"] - at["min"] > last / 4).mean() > 0.9
