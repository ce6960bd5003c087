"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of `window` tokens is filled to the queues' target shares. A queue's quota in a window is a whole
number; what rounding takes or gives is its deficit, carried to the next window. A queue that runs dry hands its
quota on to the others in proportion to theirs, which begins a new phase. Within a phase the running sum of quotas is known in closed
form, floor(w * hi) - floor(w * lo) for a queue that owns the interval [lo, hi) of the mixture, so a task finds
the windows of its documents from their place in the queue, and the deficits carry over from window to window
and from partition to partition without a hand-over.

A source too small for a few tokens a window would have its documents cut into single tokens. Such sources share one
queue, in which each one's documents are spread evenly over its whole length: there the deficit is carried in
whole documents.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, documents, mapped, stored

# Texts of these characters only are cut into words here; the tokenizer itself takes all others.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 ones stay, the others follow
    from U+0100 on; the blank, which parts pieces, stays too."""
    stay = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in stay) if b != 32}


_BYTE_LETTERS = _byte_letters()


def _pieces(word: str) -> list[str]:
    """The tokenizer's pieces of a lower-case word; plain ones need no pattern."""
    if word.isalpha():
        return [word]
    if word[:-1].isalpha() and word[-1] in ".,;:!?":
        return [word[:-1], word[-1]]
    return _PIECES.findall(word)


class WordTokens:
    """Ids of the tokenizer at path for whole texts. Its pieces never cross white space, so a word's ids
    are kept and reused; words not seen yet go to the tokenizer together."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        # it gets pieces in lower case, their bytes already as letters
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words not met again since `known` was last full are forgotten
        self.most = most

    def _learn(self, new: list[str]) -> None:
        """new: words not known; their pieces are words too, and learnt first."""
        pieces = [_pieces(w) for w in new]
        flat = list({p for ps in pieces for p in ps}.difference(self.known))
        lines = [" ".join(flat[i : i + 2000]).encode().decode("latin-1").translate(_BYTE_LETTERS) for i in range(0, len(flat), 2000)]
        ids = np.array([i for e in self.words.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int64)
        cuts = np.dtype(self.kind).itemsize * np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
        raw, known = ids.astype(self.kind).tobytes(), self.known
        known.update(zip(flat, (raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))))
        known.update((w, b"".join([known[p] for p in ps])) for w, ps in zip(new, pieces) if len(ps) > 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian and unsigned, of type `kind`."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        out, gaps, new = [], [], set()
        for n, t in enumerate(texts):
            if "<|" in t or not _PLAIN.fullmatch(t):
                out.append([np.array(self.whole.encode(t, add_special_tokens=False).ids, self.kind).tobytes()])
                continue
            ws = t.lower().split()
            ids = list(map(self.known.get, ws))
            if None in ids:
                missing = [(i, ws[i]) for i, x in enumerate(ids) if x is None]
                gaps.append((n, missing))
                new.update(w for _, w in missing)
            out.append(ids)
        if self.older and new:
            again = new.intersection(self.older)
            self.known.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self._learn(list(new))
        for n, missing in gaps:
            for i, w in missing:
                out[n][i] = self.known[w]
        return list(map(b"".join, out))


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks of a worker process: its words stay known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path)


def _tokenized(path, end_id, group_chars):
    def run(batches):
        encoder, before, part, row = word_tokens(path), {}, TaskContext.get().partitionId(), 0
        end, size = np.array([end_id], encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
        for pdf in batches:
            at = 0
            sizes = pdf.text.str.len().cumsum().to_numpy()
            while at < len(pdf):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + group_chars)))
                piece = pdf.iloc[at:to]
                ids = [x + end for x in encoder.encode(piece.text.tolist())]
                starts = []
                for q, x in zip(piece.source, ids):
                    starts.append(before.get(q, 0))
                    before[q] = starts[-1] + len(x) // size
                yield pd.DataFrame({"part": part, "row": np.arange(row, row + len(ids)), "source": piece.source, "doc_id": piece.doc_id, "n": [len(x) // size for x in ids], "before": starts, "ids": ids})
                at, row = to, row + len(ids)

    return run


def phases(sizes: dict[str, int], weights: dict[str, float]) -> dict[str, list[tuple[int, ...]]]:
    """Phases of each queue: (its tokens before, its tokens in it, all tokens before, all tokens in it, lo, hi). Queues of
    weight 0 wait until all others are dry, then go by their sizes."""
    left, used, done, out = {q: n for q, n in sizes.items() if n}, dict.fromkeys(sizes, 0), 0, {q: [] for q in sizes}
    while left:
        rate = {q: Fraction(weights.get(q, 0)) for q in left if weights.get(q, 0) > 0} or {q: Fraction(n) for q, n in left.items()}
        span = min(left[q] / rate[q] for q in rate)
        take = {q: int(span * rate[q]) for q in sorted(rate)}
        total, lo = sum(take.values()), 0
        for q, n in take.items():
            if n:
                out[q].append((used[q], n, done, total, lo, lo + n))
            lo, used[q], left[q] = lo + n, used[q] + n, left[q] - n
        done, left = done + total, {q: n for q, n in left.items() if n}
    return out


def quota_sum(w: int, first: int, lo: int, hi: int, total: int, window: int) -> tuple[int, int]:
    """Of a phase of `total` tokens after the first `first`: what the queues before the one at [lo, hi), and this one,
    have put into the first w windows."""
    filled = min(max(w * window - first, 0), total)
    below = filled * lo // total
    return below, filled * hi // total - below


def pieces(start: int, n: int, of_queue: list[tuple[int, ...]], window: int):
    """(place in the document, length, window number, offset) of n tokens from place start of a queue, by its phases."""
    for ahead, size, first, total, lo, hi in of_queue:
        at, end = max(start - ahead, 0), min(start + n - ahead, size)
        if at >= end:
            continue
        w = (first + at * total // size) // window
        below, own = quota_sum(w, first, lo, hi, total, window)
        while own > at:
            w -= 1
            below, own = quota_sum(w, first, lo, hi, total, window)
        while at < end:
            below_next, own_next = quota_sum(w + 1, first, lo, hi, total, window)
            if own_next > at:
                take = min(own_next, end) - at
                yield ahead + at - start, take, w, max(0, first - w * window) + (below_next - below) + at - own
                at += take
            w, below, own = w + 1, below_next, own_next


def _packed(of_queue, window):
    def run(batches):
        for pdf in batches:
            of, start, length, crc, sequence, offset = [], [], [], [], [], []
            for k, (queue, place, n, ids) in enumerate(zip(pdf.queue.tolist(), pdf.place.tolist(), pdf.n.tolist(), pdf.ids)):
                raw = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for at, m, w, o in pieces(place, n, of_queue[queue], window):
                    of.append(k)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + m)]))
                    sequence.append(w)
                    offset.append(o)
            yield pd.DataFrame({"doc_id": pdf.doc_id.take(of).array, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": pdf.n.take(of).array, "sequence_id": sequence, "offset": offset})

    return run


def _placed_evenly(small: DataFrame) -> DataFrame:
    """small(part, row, n, of, all_of): rows with their place in one queue, in the order of the middle of each document
    in its own source (of: tokens of the source before it, all_of: in all). A prefix sum over ranges of that order."""
    parts = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    middle = (F.col("of") + F.col("n") / 2) / F.col("all_of")
    ranged = small.select("part", "row", "n", middle.alias("middle")).repartitionByRange(parts, "middle", "part", "row").sortWithinPartitions("middle", "part", "row")

    def summed(batches):
        at, own = 0, TaskContext.get().partitionId()
        for pdf in batches:
            ends = at + pdf.n.cumsum()
            yield pd.DataFrame({"part": pdf.part, "row": pdf.row, "n": pdf.n, "span": own, "within": ends - pdf.n})
            at = int(ends.iloc[-1]) if len(ends) else at

    found = stored(ranged.mapInPandas(summed, "part int, row long, n long, span int, within long"), "even-places")
    ahead = Window.partitionBy(F.lit(0)).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    spans = stored(found.groupBy("span").agg(F.sum("n").alias("m")).select("span", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before_span")), "spans")
    return found.join(spans, "span").select("part", "row", (F.col("before_span") + F.col("within")).alias("even"))


SHARED = 0  # the queue of the small sources


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = 4096, end_id: int = 2, shares: dict[str, float] | None = None, least_quota: int = 4, group_chars: int = 2 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document (null text: empty) gives its ids and end_id, each id in exactly one piece. shares: target parts of
    a window for some sources; the others divide what is left by their sizes, or come last if nothing is left. Without
    it all have their natural shares, at which every queue lasts to the last window. A source whose natural share is
    under least_quota tokens a window, and that shares does not name, goes to the shared queue; a null source is a source like any other there. Windows are full but
    for the last. Repeated rows are packed each. Order in a queue is that of the partitions read. An empty table gives
    an empty result.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = chosen(docs, id_col, text_col, source=source_col).select("doc_id", "text", F.concat(F.lit("="), F.col("source").cast("string")).alias("source")).na.fill("null", ["source"])
    tokens = stored(mapped(rows, _tokenized(tokenizer, end_id, group_chars), f"part int, row long, source string, doc_id {kind}, n long, before long, ids binary"), "tokens")
    sums = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "queue-sums")
    sources = stored(sums.groupBy("source").agg(F.sum("n").alias("all_of")), "sources")
    total = sources.agg(F.coalesce(F.sum("all_of"), F.lit(0))).first()[0]
    named = {f"={k}": float(v) for k, v in (shares or {}).items()}
    # at most window / least_quota sources are large, besides those named
    large = sources.filter((F.col("all_of") * window >= least_quota * total) | F.col("source").isin(*named)).orderBy("source").collect()
    number = {r.source: i + 1 for i, r in enumerate(large)}
    sizes = {number[r.source]: r.all_of for r in large}
    sizes = {SHARED: total - sum(sizes.values())} | sizes
    rest = {q: n for q, n in sizes.items() if q not in {number[s] for s in named if s in number}}
    over, all_rest = max(0.0, 1 - sum(named.values())), max(1, sum(rest.values()))
    weights = {q: n for q, n in sizes.items()} if not named else {number[s]: w for s, w in named.items() if s in number} | {q: over * n / all_rest for q, n in rest.items()}
    of_queue = phases(sizes, weights)

    known = spark.createDataFrame([(s, q) for s, q in number.items()], "source string, queue int")
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(sources, "source").join(known, "source", "left").select("part", "source", "all_of", F.coalesce("queue", F.lit(SHARED)).alias("queue"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("queue_start"))
    starts = stored(starts, "queue-starts")
    # few rows for each partition: Spark broadcasts them only while they are small
    placed = tokens.join(starts, ["part", "source"]).withColumn("place", F.col("queue_start") + F.col("before"))
    if sizes[SHARED]:
        small = placed.filter(F.col("queue") == SHARED)
        even = _placed_evenly(small.select("part", "row", "n", F.col("place").alias("of"), "all_of"))
        spread = small.join(even, ["part", "row"]).withColumn("place", F.col("even"))
        columns = ["doc_id", "queue", "place", "n", "ids"]
        placed = placed.filter(F.col("queue") != SHARED).select(*columns).union(spread.select(*columns))
    return mapped(placed.select("doc_id", "queue", "place", "n", "ids"), _packed(of_queue, window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir):
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
