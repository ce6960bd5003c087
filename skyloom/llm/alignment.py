"""Alignment of two tokenizers' tokens, in Arrow from the scan to the counts.

A task encodes a slice of texts both ways into list arrays. Flattened lists and their parent indices, with cumulative
sums of token lengths from each parent's start, give every token's end; an Acero hash join on (document, end) finds
the ends that both have, which cut the tokens into groups. Links within groups are counted by Table.group_by: first a document's
own, then, for a batch of documents, in how many of them a pair is linked. Spark merges the batches' counts, and sends each
batch the corpus-wide counts of its own pairs.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, documents, stored
from .packing import _byte_letters

_SPACE = "▁"  # how the second tokenizer's pieces write a blank


class TokenPair:
    """Both tokenizers' ids of texts. Tokens of neither cross a single blank or line feed between other characters, so
    the ids of the words between them are kept and reused; all other texts are encoded whole."""

    def __init__(self, path_a: str, path_b: str, most: int = 300_000):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        raw = {letter: byte for byte, letter in _byte_letters().items()} | {ord("Ġ"): 32}
        # special tokens are no byte-level text, and never come up
        to_bytes = lambda t: bytes(raw.get(ord(c), ord(c)) for c in t) if all(ord(c) in raw or ord(c) < 256 for c in t) else t.encode()
        self.bytes_a = pa.array([to_bytes(self.a.id_to_token(i) or "") for i in range(self.size_a)], pa.binary())
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_SPACE, " ").encode()
        self.bytes_b = pa.array([piece(i) for i in range(self.size_b)], pa.binary())
        self.sizes_a, self.sizes_b = (pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b))
        # one entry for each id and place: in a group's middle, and at its end
        texts = [f"{i}{c}" for size, last in ((self.size_a, "|"), (self.size_b, ";")) for i in range(size) for c in (",", last)]
        self.texts = pa.array(texts, pa.large_binary())
        self.kind = np.dtype("<u2" if max(self.size_a, self.size_b) <= 1 << 16 else "<u4")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}  # words not met again since `known` was last full are forgotten
        self.most = most

    def _learn(self, new: list[str], at_once: int = 1000) -> None:
        """Words as in encode: with a line feed before them, else meant with a blank. Many are encoded as one text and cut where
        their bytes end, which is where tokens end."""
        for i in range(0, len(new), at_once):
            words = new[i : i + at_once]
            words.sort(key=lambda w: w[0] == "\n")  # the second tokenizer puts its blank before the first word
            parts = [w if w[0] == "\n" else " " + w for w in words]
            text = "".join(parts)
            lead = int(text[0] == "\n")  # nothing but line feeds: its blank is no word's
            ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
            ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, self.kind)
            ids_b = np.array(self.b.encode(text[1 - lead :], num_threads=1)[lead:], self.kind)
            cut = []
            for ids, sizes in ((ids_a, self.sizes_a), (ids_b, self.sizes_b)):
                total = np.cumsum(sizes[ids])
                at = np.searchsorted(total, ends)
                cut.append(np.r_[0, at + 1] if at[-1] < len(total) and (total[at] == ends).all() else None)
            if any(c is None for c in cut):
                if len(words) > 1:
                    self._learn(words, -(-len(words) // 2))
                    continue
                cut = [np.array([0, len(ids)]) for ids in (ids_a, ids_b)]
            both = []
            for ids, c in zip((ids_a, ids_b), cut):
                raw, c = ids.tobytes(), (c * self.kind.itemsize).tolist()
                both.append([raw[x:y] for x, y in zip(c, c[1:])])
            self.known.update(zip(words, zip(*both)))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of blank + text by the first tokenizer, and of text by the second, as bytes of type `kind`."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, out, gaps = self.known, [], []
        new: set[str] = set()
        for n, t in enumerate(texts):
            if _SPACE in t or not t or " ".join(t.split()) != t.replace("\n", " "):
                out.append([(np.array(self.a.encode(" " + t, add_special_tokens=False).ids, self.kind).tobytes(), np.array(self.b.encode(t, num_threads=1), self.kind).tobytes())])
                continue
            words = t.replace("\n", " \n").split(" ")
            ids = list(map(known.get, words))
            if None in ids:
                missing = [(i, words[i]) for i, x in enumerate(ids) if x is None]
                gaps.append((n, missing))
                new.update(w for _, w in missing)
            out.append(ids)
        if self.older and new:
            again = new.intersection(self.older)
            known.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self._learn(list(new))
        for n, missing in gaps:
            for i, w in missing:
                out[n][i] = known[w]
        pairs = [list(zip(*ids)) for ids in out]
        return [b"".join(a) for a, _ in pairs], [b"".join(b) for _, b in pairs]


@functools.lru_cache(maxsize=1)
def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One for all tasks of a worker process: its words stay known."""
    return TokenPair(path_a, path_b)


def _lists(raw: list[bytes], kind: np.dtype) -> pa.ListArray:
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // kind.itemsize
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(raw), kind).astype(np.int32)))


def _ends(ids: pa.ListArray, table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, end in its bytes, of every token, and the documents' byte counts."""
    flat, parent = ids.flatten(), pc.list_parent_indices(ids).to_numpy()
    total = pc.cumulative_sum(pc.take(pc.binary_length(table), flat).cast(pa.int64())).to_numpy()
    at = ids.offsets.to_numpy()
    before = np.r_[0, total][at]  # bytes before each document, and at the end
    return parent, total - before[parent], np.diff(before)


def _spelled(ids: pa.ListArray, table: pa.Array, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which documents' tokens spell their texts."""
    buffer = pc.take(table, ids.flatten()).buffers()[2]
    joined, whole = buffer.to_pybytes() if buffer else b"", b"".join(texts)
    if joined == whole and (sizes == np.fromiter(map(len, texts), np.int64, len(texts))).all():
        return np.ones(len(texts), bool)
    at = np.r_[0, np.cumsum(sizes)].tolist()
    return np.array([joined[i:j] == t for i, j, t in zip(at, at[1:], texts)], bool)


def _distinct(group: np.ndarray, ids: np.ndarray, large: np.ndarray):
    """Tokens as (group, id, times): those of large groups once for each id."""
    of_large = large[group]
    if not of_large.any():
        return group, ids, np.ones(len(ids), np.int64)
    t = pa.table({"g": group[of_large], "i": ids[of_large]}).group_by(["g", "i"], use_threads=False).aggregate([([], "count_all")])
    g = np.r_[group[~of_large], t["g"].to_numpy()]
    order = np.argsort(g, kind="stable")
    return g[order], np.r_[ids[~of_large], t["i"].to_numpy()][order], np.r_[np.ones((~of_large).sum(), np.int64), t["count_all"].to_numpy()][order]


def _links(doc: np.ndarray, group_a, a, times_a, group_b, b, times_b, size_b: int, most: int) -> pa.Table:
    """doc, key (a * size_b + b) and times of a slice's linked pairs, in the order of documents. doc: of each group. At most about
    `most` links are spread out at once."""
    n = len(doc)
    start, width = np.searchsorted(group_b, np.arange(n)), np.bincount(group_b, minlength=n)
    ends, parts, i = np.cumsum(width[group_a]), [], 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        w = width[group_a[i:j]]
        left = np.repeat(np.arange(i, j), w)
        right = start[group_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        t = pa.table({"doc": doc[group_a[left]].astype(np.int32), "key": a[left].astype(np.int64) * size_b + b[right], "times": times_a[left] * times_b[right]})
        parts.append(t.group_by(["doc", "key"], use_threads=False).aggregate([("times", "sum")]))
        i = j
    if not parts:
        return pa.table({"doc": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    out = pa.concat_tables(parts).rename_columns(["doc", "key", "times"])
    if len(parts) > 1:
        out = out.group_by(["doc", "key"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "key", "times"])
    # grouped rows stand nearly, but not always, in the order of their first row
    return out.take(pa.array(np.argsort(out["doc"].to_numpy(), kind="stable")))


def aligned(pair: TokenPair, texts: list[str], most: int = 1 << 22, large: int = 1 << 12) -> tuple[dict, pa.Table]:
    """Of each text n_a, n_b, n_groups, n_links and groups_sha256; and all documents' links (doc, key, times)."""
    raw = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
    ids_a, ids_b = (_lists(x, pair.kind) for x in pair.encode(texts))
    (_, _, sizes_a), (_, _, sizes_b) = _ends(ids_a, pair.bytes_a), _ends(ids_b, pair.bytes_b)
    good = _spelled(ids_a, pair.bytes_a, sizes_a, raw) & _spelled(ids_b, pair.bytes_b, sizes_b, raw) & np.fromiter(map(bool, texts), bool, len(texts))
    if not good.all():
        ids_a, ids_b = (pc.if_else(pa.array(good), x, pa.scalar([], x.type)) for x in (ids_a, ids_b))
    (doc_a, end_a, _), (doc_b, end_b, _) = _ends(ids_a, pair.bytes_a), _ends(ids_b, pair.bytes_b)
    a, b = ids_a.flatten().to_numpy(), ids_b.flatten().to_numpy()
    keyed = lambda doc, end, name: pa.table({"doc": doc.astype(np.int32), "end": end.astype(np.int32) if len(end) == 0 or end.max() < 1 << 31 else end, name: np.arange(len(end), dtype=np.int32)})
    both = keyed(doc_a, end_a, "at_a").join(keyed(doc_b, end_b, "at_b"), ["doc", "end"], join_type="inner", use_threads=False)
    last_a, last_b = np.zeros(len(a), np.int32), np.zeros(len(b), np.int32)
    last_a[both["at_a"].to_numpy()] = 1
    last_b[both["at_b"].to_numpy()] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    doc, n = doc_a[last_a == 1], int(last_a.sum())
    n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    per_doc = lambda of, w=None: np.bincount(of, w, minlength=len(texts)).astype(np.int64)
    sums = {"n_a": per_doc(doc_a), "n_b": per_doc(doc_b), "n_groups": per_doc(doc)}
    links = np.r_[0, np.cumsum(n_a * n_b)]
    cuts = np.r_[0, np.cumsum(sums["n_groups"])]
    sums["n_links"] = links[cuts[1:]] - links[cuts[:-1]]

    code = np.empty(len(a) + len(b), np.int64)  # groups one after the other, the first tokenizer's ids first
    code[np.arange(len(a)) + np.r_[0, np.cumsum(n_b)][group_a]] = 2 * a + last_a
    code[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = 2 * (pair.size_a + b) + last_b
    line = pc.take(pair.texts, pa.array(code))
    at = np.frombuffer(line.buffers()[1], np.int64)[np.r_[0, np.cumsum(sums["n_a"] + sums["n_b"])]].tolist()
    view = memoryview(line.buffers()[2] or b"")
    sums["groups_sha256"] = [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:])]

    many = n_a * n_b > large
    return sums, _links(doc, *_distinct(group_a, a, many), *_distinct(group_b, b, many), pair.size_b, most)


_SUMS = ("n_a", "n_b", "n_groups", "n_links")
_OWN = "batch long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ranks array<int>, times array<int>, rank int, key long, n long"


def _batches(paths, schema: pa.Schema, slice_chars: int, batch_chars: int):
    """Rows of documents with the ranks of their pairs in their batch, and rows of the batch's pairs with key and the number of its documents."""

    def rows(columns: dict, n: int):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def emit(number, held):
        """held: (ids, sums, links) of slices."""
        counts = pa.concat_tables([pa.table({"key": links["key"]}) for _, _, links in held]).group_by("key", use_threads=False).aggregate([([], "count_all")])
        counts = counts.sort_by([("count_all", "descending"), ("key", "ascending")]).combine_chunks()
        values = counts["key"].combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        for ids, sums, links in held:
            n = len(ids)
            cuts = pa.array(np.searchsorted(links["doc"].to_numpy(), np.arange(n + 1)), pa.int32())
            flat = lambda x: pa.concat_arrays([c.cast(pa.int32()) for c in x.chunks]) if x.chunks else pa.array([], pa.int32())
            ranks = pc.index_in(links["key"], values)
            lists = {"ranks": pa.ListArray.from_arrays(cuts, flat(ranks)), "times": pa.ListArray.from_arrays(cuts, flat(links["times"]))}
            yield rows({"batch": pa.array(np.full(n, number)), "doc_id": ids, **sums, **lists}, n)
        for i in range(0, len(values), 1 << 16):
            part = counts.slice(i, 1 << 16)
            yield rows({"batch": pa.array(np.full(len(part), number)), "rank": np.arange(i, i + len(part)), "key": part["key"].to_numpy(), "n": part["count_all"].to_numpy()}, len(part))

    def run(batches):
        pair = token_pair(*paths)
        number, held, chars = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes, at = np.cumsum(pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False)), 0
            while at < len(batch):
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + slice_chars, "right")))
                part = batch.slice(at, to - at)
                held.append((part["doc_id"], *aligned(pair, part["text"].to_pylist())))
                chars, at = chars + int(sizes[to - 1] - before), to
                if chars > batch_chars:
                    yield from emit(number, held)
                    number, held, chars = number + 1, [], 0
        if held:
            yield from emit(number, held)

    return run


def _merged(kind: str):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["rank"].to_numpy())
        count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
        out = {c: docs[c] for c in ("doc_id", *_SUMS)}
        sums = {"n_best": [], "count_sum": []}
        for batch in docs.to_batches():
            ranks, times = (batch[c].flatten().to_numpy() for c in ("ranks", "times"))
            parent = pc.list_parent_indices(batch["ranks"]).to_numpy()
            # whole numbers: sums from each document's start to its end
            at = np.searchsorted(parent, np.arange(len(batch) + 1))
            for name, w in (("n_best", times * best[ranks]), ("count_sum", times * count[ranks])):
                total = np.r_[0, np.cumsum(w, dtype=np.int64)]
                sums[name].append(pa.array(total[at[1:]] - total[at[:-1]]))
        out |= {k: pa.chunked_array(v, pa.int64()) for k, v in sums.items()}
        return pa.table({**out, "groups_sha256": docs["groups_sha256"]})

    return run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _prepared(docs, path_a, path_b, id_col, text_col, slice_chars, batch_chars):
    """Stored rows of documents and of batches' pairs; and corpus-wide counts of pairs (key, count, best)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    pair = token_pair(path_a, path_b)
    made = _OWN.format(kind=dict(docs.dtypes)[id_col])
    run = _batches((path_a, path_b), to_arrow_schema(StructType.fromDDL(made)), slice_chars, batch_chars)
    own = stored(chosen(docs, id_col, text_col).mapInArrow(run, made), "links")
    pairs = own.filter("rank IS NOT NULL").select("batch", "rank", "key", "n")
    first = F.expr(f"key div {pair.size_b}")
    counts = stored(pairs.groupBy("key").agg(F.sum("n").alias("count")).withColumn("a", first), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return own, pairs, counts.join(most, "a").select("key", "a", (F.col("key") - F.col("a") * pair.size_b).alias("b"), "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 1 << 20, batch_chars: int = 1 << 24) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level tokenizers file, which encodes a blank and the text; path_b: a sentencepiece model, which adds the blank. Texts
    that are null, empty, or not spelled by both (say, with U+2581 in them) have zeros and ''. A pair's count is the
    number of rows that hold it linked, repeated rows each. A task holds a batch of batch_chars characters' distinct links, or one
    text's if that is longer; a group's links are spread out in bounded pieces, each id of a large group once. An
    empty table gives an empty result."""
    own, pairs, counts = _prepared(docs, path_a, path_b, id_col, text_col, slice_chars, batch_chars)
    known = pairs.join(counts.select("key", "count", "best"), "key").select(F.col("batch").alias("of_batch"), "rank", "count", "best")
    run, made = _merged(dict(docs.dtypes)[id_col])
    rows = own.filter("rank IS NULL").select("batch", "doc_id", *_SUMS, "groups_sha256", "ranks", "times")
    return rows.groupBy("batch").cogroup(known.groupBy("of_batch")).applyInArrow(run, made)


def vocabulary_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 1 << 20, batch_chars: int = 1 << 24) -> DataFrame:
    """All linked id pairs of the corpus: a, b, count (rows that hold it) and best (whether no other b has more with this a)."""
    return _prepared(docs, path_a, path_b, id_col, text_col, slice_chars, batch_chars)[2].select("a", "b", "count", "best")


def query(spark, sf_dir):
    import public_tokenizers

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
