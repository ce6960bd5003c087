"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for test suffixes.

A shard is a batch of documents. Its suffix array holds the runs of words that the tests know at all;
every suffix of every test item is looked up by binary search, equal ones once, which gives all places of its
window; from there the items' own suffix array tells the longest verbatim match. The tests are taken in blocks of bounded size, so what is sent to the
tasks has a bound however many tests there are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, documents, mapped, stored
from .licenses import words
from .repeats import _common


class Items:
    """A block of items as word numbers, in big-endian bytes, so that bytes order as words do: the distinct windows
    with their items, and a suffix array of the items that have more than a window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[bytes, set[str]] = {}
        self.names = sorted({item for item, _ in items})
        rank = {name: i for i, name in enumerate(self.names)}
        row, of, self.longest = [], [], 0
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if not ids:
                continue
            n, raw = min(window, len(ids)), np.array(ids, ">u4").tobytes()
            for p in range(len(ids) - n + 1):
                self.windows.setdefault(raw[4 * p : 4 * (p + n)], set()).add(item)
            if len(ids) >= window:
                row += [*ids, 0]
                of += [rank[item]] * (len(ids) + 1)
                self.longest = max(self.longest, len(ids))
        self.least = min((len(w) // 4 for w in self.windows), default=None)
        self.raw, self.of = np.array(row, ">u4").tobytes(), np.array(of, np.int32)
        self.order = suffix_array(np.array(row, np.int64), self.longest + 1) if row else np.zeros(0, np.int64)

    def longest_match(self, text: bytes) -> tuple[int, str]:
        """Words of the longest match of an item's part with the beginning of text, and the first such item."""
        key = lambda i: self.raw[4 * i : 4 * i + len(text)]
        at = bisect_left(self.order, text, key=key)
        n = max(_common(text, key(i)) for i in self.order[max(0, at - 1) : at + 1].tolist()) // 4
        text = text[: 4 * n]
        lo = bisect_left(self.order, text, key=key)
        return n, self.names[self.of[self.order[lo : bisect_right(self.order, text, lo=lo, key=key)]].min()]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids ordered by the depth numbers from each on, by doubling."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        nxt = np.zeros_like(rank)
        nxt[: max(0, len(rank) - width)] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


def search_shard(texts: list[str], tests: Items) -> list[tuple]:
    """For each text: n_words, hit word places, items, longest match (words, place, item)."""
    ids_of, runs, n_words = [], [], []
    get = tests.numbers.get
    for d, text in enumerate(texts):
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        n_words.append(len(ids))
        edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if tests.least is not None and b - a >= tests.least:
                ids_of.append(ids[a:b])
                runs.append((d, a, b - a))
    out = [(n, np.zeros(0, np.int64), [], (0, None, None)) for n in n_words]
    if not runs:
        return out
    shard = np.concatenate([x for r in ids_of for x in (r, [0])])
    first = np.cumsum([0] + [n + 1 for _, _, n in runs])
    doc_of = np.repeat([d for d, _, _ in runs], [n + 1 for _, _, n in runs])
    place_of = np.concatenate([np.arange(a, a + n + 1) for _, a, n in runs])
    assert first[-1] == len(shard) == len(place_of)
    order = suffix_array(shard, tests.window).tolist()
    raw = shard.astype(">u4").tobytes()
    hit, whole = np.zeros(len(shard) + 1, np.int64), np.zeros(len(shard), bool)
    found_items: dict[int, set[str]] = {}
    best: dict[int, tuple] = {}
    for head, items in tests.windows.items():
        key = lambda i, m=len(head): raw[4 * i : 4 * i + m]
        lo = bisect_left(order, head, key=key)
        if lo == len(order) or key(order[lo]) != head:
            continue
        n, at = len(head) // 4, np.sort(order[lo : bisect_right(order, head, lo=lo, key=key)])
        hit[at] += 1
        hit[at + n] -= 1
        docs, where = np.unique(doc_of[at], return_index=True)
        for d, i in zip(docs.tolist(), at[where].tolist()):
            found_items.setdefault(d, set()).update(items)
            if n < tests.window:
                new = (n, int(place_of[i]), min(items))
                if d not in best or (-new[0], *new[1:]) < (-best[d][0], *best[d][1:]):
                    best[d] = new
        if n == tests.window:
            whole[at] = True
    if not found_items:
        return out
    # a match is no longer than the windows that follow one another from its start on, and than an item
    starts = np.flatnonzero(whole)
    cut = np.flatnonzero(np.diff(starts) != 1)
    last = np.repeat(starts[np.r_[cut, len(starts) - 1]], np.diff(np.r_[-1, cut, len(starts) - 1])) if len(starts) else starts
    for i, most in zip(starts.tolist(), np.minimum(last - starts + tests.window, tests.longest).tolist()):
        d = int(doc_of[i])
        if d not in best or most > best[d][0]:
            n, item = tests.longest_match(raw[4 * i : 4 * (i + most)])
            if d not in best or n > best[d][0]:
                best[d] = (n, int(place_of[i]), item)
    hit = np.cumsum(hit)[:-1] > 0
    hit_docs, hit_places = doc_of[hit], place_of[hit]
    for d in found_items:  # hit_docs is in order
        a, b = np.searchsorted(hit_docs, [d, d + 1])
        out[d] = (n_words[d], hit_places[a:b], sorted(found_items[d]), best[d])
    return out


_RAW = "n_words long, hits array<int>, items array<string>, best struct<m: long, at: long, item: string>"


def _search(tests):
    def run(batches):
        for pdf in batches:
            got = search_shard(pdf.text.tolist(), tests)
            yield pd.DataFrame(
                {
                    "doc_id": pdf.doc_id,
                    "d1": pdf.d1,
                    "n_words": [x[0] for x in got],
                    "hits": [x[1].astype(np.int32) for x in got],
                    "items": [x[2] for x in got],
                    "best": [{"m": x[3][0], "at": x[3][1], "item": x[3][2]} for x in got],
                }
            )

    return run


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", test_col: str = "text", window: int = 13, share: int = 20, block_chars: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match,
    longest_at, longest_item.

    A window is `window` consecutive item words, or the whole of a shorter item; contaminated if any word
    is hit and share * n_hit >= n_words. Null texts and items have no words; items without words, and null
    item ids, match nothing. Texts of items that share an id are windows of one item. Among longest matches
    the first place, then the first item wins. Repeated rows stay as many. Without tests nothing is hit.
    """
    kind = dict(docs.dtypes)[id_col]
    items = tests.select(F.col(item_col).cast("string").alias("item"), F.col(test_col).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    rows = chosen(docs, id_col, text_col).withColumn("d1", F.xxhash64("text"))
    raw = None
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        block = Items([(r.item, r.text) for r in part.toLocalIterator()], window)
        found = mapped(rows, _search(block), f"doc_id {kind}, d1 long, {_RAW}")
        found = found if n_blocks == 1 else stored(found, "hits")
        raw = found if raw is None else raw.unionByName(found)
    first = F.struct(-F.col("best.m"), F.col("best.at"), F.col("best.item"))
    if n_blocks > 1:  # a document's hits from all blocks; repeated rows are counted and dealt out again
        raw = (
            raw.groupBy("doc_id", "d1", "n_words")
            .agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.min_by("best", first).alias("best"), (F.count(F.lit(1)) / n_blocks).cast("int").alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        )
    n_hit = F.size("hits").cast("long")
    return raw.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("best.m").alias("longest_match"),
        F.col("best.at").alias("longest_at"),
        F.col("best.item").alias("longest_item"),
    )


def query(spark, sf_dir):
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
