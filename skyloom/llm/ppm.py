"""Language-model scores by prediction by partial matching over bytes, beside a word baseline.

The byte-context trie has contexts of up to `order` bytes. It is a Spark table of (context, symbol)
counts over all training texts that grows with them and is never gathered: each batch of texts gives
its distinct (context, symbol) pairs, escapes (method C: as often as there are distinct symbols) and
symbol exclusion are worked out by joins between the levels of the trie, and the frozen probabilities
are joined to the pairs of each batch. `Trie` is the same model of order 2 in one process.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, documents, id_bucket, stored

_CHUNK = 2 << 20


def _joined(texts: list[bytes]):
    """Groups of whole texts of about _CHUNK bytes, and longer ones in overlapping cuts: (numbers, bytes,
    first byte to count of each); two zero bytes stand before a text."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t)), _CHUNK):
            part = (b"\0\0" + t[:_CHUNK]) if at == 0 else t[at - 2 : at + _CHUNK]
            held.append((k, part))
            size += len(part)
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (two context bytes, symbol) and counts."""
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for held in _joined(texts):
        b = np.frombuffer(b"".join(p for _, p in held), np.uint8)
        # a small alphabet makes the table of counts small
        letters = np.flatnonzero(np.bincount(b, minlength=256))
        to = np.zeros(256, np.int32)
        to[letters] = np.arange(len(letters))
        c, n = to[b], len(letters)
        gram = (c[:-2] * n + c[1:-1]) * n + c[2:]
        use = np.ones(len(b), bool)
        ends = np.cumsum([len(p) for _, p in held])
        starts = np.r_[0, ends[:-1]]
        use[starts] = use[starts + 1] = False  # context only
        got = np.bincount(gram[use[2:]], minlength=1)
        at = np.flatnonzero(got)
        codes.append(letters[at // (n * n)] << 16 | letters[at // n % n] << 8 | letters[at % n])
        counts.append(got[at])
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(counts), len(code)).astype(np.int64)


class Trie:
    """Frozen: log10 probability of each symbol in each context."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        context = np.unique(code >> 8)
        two = np.zeros((len(context), 256))
        two[np.searchsorted(context, code >> 8), code & 255] = count
        one = np.zeros((256, 256))
        np.add.at(one, context & 255, two)
        zero = one.sum(axis=0)
        rows = [self._mix(one, [zero])]
        for b in range(256):
            if (own := np.flatnonzero((context & 255) == b)).size:
                rows.append(self._mix(two[own], [one[b], zero]))
        order = np.concatenate([np.flatnonzero((context & 255) == b) for b in range(256)]) if len(context) else np.zeros(0, int)
        self.row = np.tile(np.arange(256, dtype=np.int32), 256)  # an unseen context falls to its last byte
        self.row[context[order]] = 256 + np.arange(len(order), dtype=np.int32)
        self.table = np.concatenate(rows).astype(np.float32)

    @staticmethod
    def _mix(counts, below):
        """Escape down through the count vectors of `below`, symbols seen above excluded at each level."""
        p = np.zeros(counts.shape)
        left = np.ones((len(counts), 1))
        excluded = np.zeros(counts.shape, bool)
        for c in [counts, *(np.broadcast_to(x, counts.shape) for x in below)]:
            c = np.where(excluded, 0, c)
            seen = c > 0
            n, u = c.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
            p = np.where(seen, left * c / np.maximum(1, n + u), p)
            left = left * np.where(n > 0, u / np.maximum(1, n + u), 1.0)
            excluded = excluded | seen
        rest = (~excluded).sum(axis=1, keepdims=True)
        # with no symbol left the last escape has nothing to say: its share goes back to all symbols
        p = np.where(excluded, p, left / np.maximum(1, rest))
        return np.log10(p / p.sum(axis=1, keepdims=True))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for held in _joined(texts):
            b = np.frombuffer(b"".join(p for _, p in held), np.uint8)
            context = b[:-2].astype(np.int32) << 8 | b[1:-1]
            bits = np.r_[0.0, 0.0, np.cumsum(self.table[self.row[context], b[2:]], dtype=np.float64)]
            ends = np.cumsum([len(p) for _, p in held])
            for (k, part), end in zip(held, ends.tolist()):
                out[k] += bits[end - 1] - bits[end - len(part) + 1] if len(part) > 2 else 0.0
        return out


def adaptive_score(text: bytes, order: int = 2) -> float:
    """log10 probability of a text under a trie that learns it byte by byte, from nothing."""
    trie: dict[bytes, Counter] = {}
    total = 0.0
    for i, s in enumerate(text):
        excluded: set[int] = set()
        for k in range(min(order, i), -1, -1):
            c = trie.get(text[i - k : i], {})
            live = {x: n for x, n in c.items() if x not in excluded}
            if live:
                n = sum(live.values()) + len(live)
                total += np.log10((live[s] if s in live else len(live)) / n)
                if s in live:
                    break
            excluded |= set(c)
        else:
            total += -np.log10(256 - len(excluded))
        for k in range(min(order, i) + 1):
            trie.setdefault(text[i - k : i], Counter())[s] += 1
    return float(total)


def _buffer(texts: list[bytes], order: int):
    """Texts one after the other, `order` zero bytes before each; which bytes are a text's own; first byte and end of each."""
    pad = b"\0" * order
    b = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + order)
    starts = ends - sizes
    own = np.ones(len(b), bool)
    for j in range(1, order + 1):
        own[starts - j] = False
    return b, own, starts, ends


def _codes(b: np.ndarray, order: int, a: int, z: int) -> np.ndarray:
    """(context, symbol) of the bytes a..z, a not below order."""
    v = b[a - order : z].astype(np.int64)
    code = np.zeros(z - a, np.int64)
    for j in range(order + 1):
        code = code << 8 | v[j : j + z - a]
    return code


def _slices(b: np.ndarray, order: int):
    return ((a, min(a + _CHUNK, len(b))) for a in range(order, len(b), _CHUNK))


def context_counts(texts: list[bytes], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, symbol) codes of all texts, ascending, and how often each is in the training ones."""
    b, own, _, ends = _buffer(texts, order)
    taught = np.repeat(train, np.diff(ends, prepend=0)) if len(texts) else own
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, z in _slices(b, order):
        at, code = pd.factorize(_codes(b, order, a, z)[own[a:z]])
        codes.append(code)
        counts.append(np.bincount(at, taught[a:z][own[a:z]], len(code)))
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(counts), len(code)).astype(np.int64)


def _sums(texts: list[bytes], order: int, code: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum of p over the (context, symbol) codes of each text."""
    b, own, starts, ends = _buffer(texts, order)
    index, out = pd.Index(code), np.zeros(len(texts))
    for a, z in _slices(b, order):
        keep = own[a:z]
        value = np.zeros(z - a)
        value[keep] = p[index.get_indexer(_codes(b, order, a, z)[keep])]
        value = np.r_[0.0, np.cumsum(value)]
        out += value[np.clip(ends, a, z) - a] - value[np.clip(starts, a, z) - a]
    return out


def frozen(grams: DataFrame, order: int) -> DataFrame:
    """grams: code (context and symbol), n (0 if no training text has it) -> code, p: log10 probability of the
    symbol in its context. A level of the trie is the sum of the level above it over the first context byte, so
    what a context has seen is seen in all its shorter ones: exclusion takes the context's own symbols off the
    totals of the next. UTF-8 never has all 256 bytes, so some are always left below order 0."""
    low = lambda k: F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
    pairs = {order: grams.filter("n > 0")}
    for k in range(order - 1, -1, -1):
        pairs[k] = stored(pairs[k + 1].groupBy(low(k).alias("code")).agg(F.sum("n").alias("n")), f"pairs-{k}")
    contexts = {}
    for k in range(1, order + 1):
        shorter = pairs[k - 1].select(F.col("code").alias("short"), F.col("n").alias("below"))
        found = pairs[k].withColumn("short", low(k - 1)).join(shorter, "short")
        contexts[k] = stored(found.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("below").alias("below")), f"contexts-{k}")
    seen = pairs[order].withColumn("context", F.shiftright("code", 8)).join(contexts[order], "context")
    seen = seen.select("code", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("p"))

    root = pairs[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    rest = grams.filter("n = 0").select("code", F.lit(0.0).alias("escaped"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds"), F.lit(None).cast("double").alias("p"))
    for k in range(order, -1, -1):
        rest = rest.withColumn("short", low(k)).withColumn("context", F.shiftright("short", 8))
        if k:
            rest = rest.join(contexts[k], "context", "left").na.fill(0, ["total", "kinds", "below"])
        else:
            rest = rest.withColumns({"total": F.lit(root.total), "kinds": F.lit(root.kinds), "below": F.lit(0)})
        rest = rest.join(pairs[k].select(F.col("code").alias("short"), "n"), "short", "left")
        live, all_of = F.col("total") - F.col("gone"), F.col("total") - F.col("gone") + F.col("kinds") - F.col("gone_kinds")
        rest = rest.select(
            "code",
            F.when(live > 0, F.col("escaped") + F.log10((all_of - live) / all_of)).otherwise(F.col("escaped")).alias("escaped"),
            F.col("below").cast("long").alias("gone"),
            F.col("kinds").cast("long").alias("gone_kinds"),
            F.coalesce("p", F.when(F.col("n").isNotNull(), F.col("escaped") + F.log10(F.col("n") / all_of))).alias("p"),
        )
    return seen.union(rest.select("code", F.coalesce("p", F.col("escaped") - F.lit(float(np.log10(256 - root.kinds)))).alias("p")))


# kind 0: a batch (its numbers of training texts and of words in them, digests of its texts, their sizes in bytes, the
# texts); 1: a token of a batch, its number there and count in training texts; 2: a (context, symbol) code of a batch and its count in training texts
_GATHERED = "kind int, batch long, token binary, number long, n long, d1 array<long>, d2 array<long>, sizes array<int>, stream binary"


def _pieces(batches, chars):
    """Runs of rows of about `chars` characters over the batches, whole texts each: few and large, as a token or code
    is one row a run."""
    held, size = [], 0
    for pdf in batches:
        ends = np.r_[0, pdf.text.str.len().cumsum().to_numpy()]
        at = 0
        while at < len(pdf):
            to = min(len(pdf), max(at + 1, int(np.searchsorted(ends, ends[at] + chars - size))))
            held.append(pdf.iloc[at:to])
            size += int(ends[to] - ends[at])
            at = to
            if size >= chars:
                yield pd.concat(held)
                held, size = [], 0
    if held:
        yield pd.concat(held)


def _numbered(raw: list[bytes]):
    """Number of each distinct token in order of first sight, the numbers of all tokens, tokens a text."""
    numbers: dict[bytes, int] = {}
    sizes, stream = [], [np.zeros(0, np.uint32)]
    for r in raw:
        tokens = r.lower().split()
        for t in tokens:
            numbers.setdefault(t, len(numbers))
        stream.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
        sizes.append(len(tokens))
    return numbers, np.concatenate(stream), sizes


def _gather(order, chars=16 << 20):
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for pdf in _pieces(batches, chars):
            raw = [t.encode("utf-8", "surrogatepass") for t in pdf.text]
            train = pdf.train.to_numpy(bool)
            numbers, flat, sizes = _numbered(raw)
            count = np.bincount(flat[np.repeat(train, sizes)], minlength=len(numbers)) if len(numbers) else np.zeros(0, np.int64)
            batch = part << 32 | k
            k += 1
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
            yield pd.DataFrame({"kind": 0, "batch": [batch], "token": None, "number": train.sum(), "n": count.sum(), "d1": [pdf.d1.tolist()], "d2": [pdf.d2.tolist()], "sizes": [list(map(len, raw))], "stream": [packed]})
            names = list(numbers)
            for i in range(0, len(names), 50_000):
                m = len(names[i : i + 50_000])
                yield pd.DataFrame({"kind": 1, "batch": batch, "token": names[i : i + m], "number": np.arange(i, i + m), "n": count[i : i + m], "d1": None, "d2": None, "sizes": None, "stream": None})
            del numbers, names, flat
            code, n = context_counts(raw, train, order)
            for i in range(0, len(code), 200_000):
                yield pd.DataFrame({"kind": 2, "batch": batch, "token": None, "number": code[i : i + 200_000], "n": n[i : i + 200_000], "d1": None, "d2": None, "sizes": None, "stream": None})

    return run


def _answer(smoothing, order):
    """found: of, at, v, first: the count of token -1 - at, first in one of its batches, or the log10 probability of
    code at. A batch's first row also tells how many of its tokens are first and known: all batches' sum counts each once."""

    def run(batch, found):
        out = []
        at, v = found["at"].to_numpy(), found.v.to_numpy()
        for r in batch.itertuples(index=False):
            whole, cut = zstandard.ZstdDecompressor().decompress(r.stream), np.r_[0, np.cumsum(r.sizes)].astype(int).tolist()
            raw = [whole[a:b] for a, b in zip(cut[:-1], cut[1:])]
            numbers, flat, sizes = _numbered(raw)
            c = np.zeros(len(numbers))
            c[-1 - at[at < 0]] = v[at < 0]
            value = np.r_[0.0, np.cumsum(np.log10(c + smoothing)[flat])] if len(flat) else np.zeros(1)
            known = np.r_[0, np.cumsum((c > 0)[flat])] if len(flat) else np.zeros(1, np.int64)
            ends = np.cumsum(sizes)
            starts = np.r_[0, ends[:-1]].astype(int)
            score = _sums(raw, order, at[at >= 0], v[at >= 0])
            kinds = np.zeros(len(raw), np.int64)
            kinds[0] = ((at < 0) & (v > 0) & found["first"].to_numpy(bool)).sum()
            out.append(pd.DataFrame({"d1": r.d1, "d2": r.d2, "words": sizes, "known": known[ends] - known[starts], "kinds": kinds, "log_sum": value[ends] - value[starts], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("d1", "d2", "words", "known", "kinds", "log_sum", "score")})

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, smoothing: float = 0.1, order: int = 4) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    base_score: tokens between [\\x20\\x09-\\x0D], and one end a text, under smoothed counts of the training
    texts. score: log10 probability of the text's bytes under the pretrained trie of `order` context bytes (1 to
    6); an empty text scores 0. Null text counts as empty, a null doc_id falls into fold crc32('') mod folds.
    Repeated rows score alike, each taught once. Without training texts all counts are 0 and bytes are equally likely.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6: a context and its symbol are one long")
    rows = chosen(docs, id_col, text_col).select("doc_id", "text", (id_bucket("doc_id", folds) != held_fold).alias("train"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    gathered = stored(rows.select("text", "train", "d1", "d2").mapInPandas(_gather(order), _GATHERED), "gathered")
    codes = gathered.filter("kind = 2").select("batch", F.col("number").alias("code"), "n")
    model = stored(frozen(stored(codes.groupBy("code").agg(F.sum("n").alias("n")), "grams"), order), "model")

    # a token is one row a batch: its counts are summed and given back in one shuffle, by a window that spills
    of_token = Window.partitionBy("token")
    known = gathered.filter("kind = 1").select(
        F.col("batch").alias("of"), (-1 - F.col("number")).alias("at"), F.sum("n").over(of_token).cast("double").alias("v"), (F.row_number().over(of_token.orderBy("batch")) == 1).alias("first")
    )
    known = known.union(codes.select("batch", "code").join(model, "code").select("batch", "code", "p", F.lit(False)))
    texts = gathered.filter("kind = 0").select("batch", "d1", "d2", "sizes", "stream")
    answers = texts.groupBy("batch").cogroup(known.groupBy("of")).applyInPandas(_answer(smoothing, order), "d1 long, d2 long, words long, known long, kinds long, log_sum double, score double")
    answers = stored(answers, "answers")
    base = stored(answers.groupBy("d1", "d2").agg(*(F.max(c).alias(c) for c in ("words", "known", "log_sum", "score"))), "base")
    seen = gathered.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("number"), F.lit(0)).alias("ends")).first()
    ends, n_train = seen.ends, seen.n + seen.ends
    distinct = (answers.agg(F.sum("kinds")).first()[0] or 0) + (ends > 0)

    scored = rows.select("doc_id", (~F.col("train")).alias("held_out"), "d1", "d2", F.octet_length("text").alias("n_bytes"))
    log_all = float(np.log10(n_train + smoothing * (distinct + 1)))
    log_end = float(np.log10(ends + smoothing))
    return scored.join(base, ["d1", "d2"]).select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_sum") + log_end - (F.col("words") + 1) * log_all).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark, sf_dir):
    return lm_score(documents(spark, sf_dir))
