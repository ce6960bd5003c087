"""Repeated substrings by sharded enhanced suffix arrays and their common-prefix interval trees.

A string of `length` bytes has one anchor: of its `gram`-byte substrings the one with the smallest hash,
the first of equals. Equal strings have equal anchors at equal places, so shards by anchor hold all
occurrences of a string. Only anchors that occur twice matter. A shard is the list of their
occurrences, each with the bytes of the strings that the anchor stands for; it is sorted as a suffix
array from the anchor on, and a stack-scan of its common prefixes gives the interval tree. In each
interval the texts to the left of the anchors are compared: how far they agree, and where they
differ (left-extension diversity), bounds the maximal repeats, all of whose occurrences are marked.
`remove_repeats` takes them out of the texts; `repeat_groups` gives the groups themselves with all occurrences.

A shard with more than `shard_capacity` occurrences is not given to one task. Equal contexts are first
counted together, and shards that are still large are halved: strings that reach further to the left of
the anchor than the middle agree there, the others agree further to the right, so either half is dealt
out anew by the bytes it must share, until a half stands for one string alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import chosen, documents, stored

_BASE = 0x9E3779B97F4A7C15
_CUT = 4 << 20


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram (a power of two) bytes from each place on, by doubling; 64 bits."""
    h, width, mult = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, _BASE
    while width < gram:
        h = h[:-width] * np.uint64(mult) + h[width:]
        mult, width = mult * mult % (1 << 64), 2 * width
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: place, hash, first and last start of the strings that each stands for. The smallest hash is
    that of the smallest first 40 bits."""
    place, hashes, first, last = [], [], [], []
    n_strings = len(raw) - length + 1
    for at in range(0, max(0, n_strings), _CUT):
        b = np.frombuffer(raw[at : at + _CUT + length - 1], np.uint8)
        h = _gram_hashes(b, gram)
        # smallest of each run of w: suffix minima of blocks of w against prefix minima of the next
        w, n = length - gram + 1, len(h)
        packed = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
        block = np.concatenate([packed, pad]).reshape(-1, w)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - w + 1
        least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
        at_place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, at_place[1:] != at_place[:-1]])
        place.append(at_place[new] + at)
        hashes.append(h[at_place[new]].view(np.int64))
        first.append(new + at)
        last.append(np.r_[new[1:], m] - 1 + at)
    if not place:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in (place, hashes, first, last))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def intervals(suffixes: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Common-prefix intervals of sorted suffixes by stack-scan: (prefix, prefix of the parent, first, last)."""
    n = len(suffixes)
    lcp = [0] + [_common(suffixes[i - 1], suffixes[i]) for i in range(1, n)] + [-1]
    out, stack = [], [(0, 0)]
    for i in range(1, n + 1):
        lb = i - 1
        while stack and stack[-1][0] > lcp[i]:
            depth, lb = stack.pop()
            out.append((depth, max(lcp[i], stack[-1][0] if stack else 0), lb, i - 1))
        if not stack or stack[-1][0] < lcp[i]:
            stack.append((lcp[i], lb))
    return out


def marked(shard: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """For each occurrence (right, left reversed, lowest and highest reach, count), the reaches (bytes of a
    string before its anchor) at which the string is repeated, as inclusive ranges. right starts at the anchor."""
    out = [[] for _ in shard]

    def put(i, lo, hi):
        lo, hi = max(lo, shard[i][2]), min(hi, shard[i][3])
        if lo <= hi:
            out[i].append((lo, hi))

    for i, x in enumerate(shard):
        if x[4] > 1:
            put(i, x[2], x[3])
    if len(shard) == 2:
        r, left = _common(shard[0][0], shard[1][0]), _common(shard[0][1], shard[1][1])
        put(0, length - r, left)
        put(1, length - r, left)
        return out
    order = sorted(range(len(shard)), key=lambda i: shard[i][0])
    for depth, parent, a, b in intervals([shard[i][0] for i in order]):
        members = sorted(order[a : b + 1], key=lambda i: shard[i][1])
        agree = [0] + [_common(shard[i][1], shard[j][1]) for i, j in zip(members, members[1:])] + [0]
        for k, i in enumerate(members):
            # beyond the parent's prefix the interval alone holds the string's right part
            put(i, length - depth, min(length - parent - 1, max(agree[k], agree[k + 1])))
    return out


def grouped(shard: list[tuple], length: int) -> list[tuple[int, int, list[int]]]:
    """Repeats of a shard as for marked(): (bytes before the anchor, bytes from it on, occurrences), one for each set of
    occurrences that some string of `length` bytes has; the bytes are what these share within the shard. A string with r bytes before
    the anchor has the occurrences of a right interval deeper than length - r bytes whose parent is not, and there of a
    left interval of r bytes or more whose parent has fewer."""
    each = [i for i, x in enumerate(shard) for _ in range(min(x[4], 2))]  # equal contexts repeat each other
    order, out = sorted(each, key=lambda i: shard[i][0]), []
    for depth, parent, a, b in intervals([shard[i][0] for i in order]):
        members = sorted(order[a : b + 1], key=lambda i: shard[i][1])
        for left, outer, c, d in intervals([shard[i][1] for i in members]):
            lowest = max(outer + 1 if left else 0, length - depth)
            if c < d and lowest <= min(left, length - parent - 1):
                out.append((left, depth, sorted(set(members[c : d + 1]))))
    return out


def _find(length, gram, most=1 << 18):
    def run(batches):
        seen = set()
        for pdf in batches:
            out = []
            if len(seen) > most:  # forgotten copies are looked at again, no more
                seen = set()
            for d1, d2, t in zip(pdf.d1, pdf.d2, pdf.text):
                if (d1, d2) in seen:  # copies in one partition need one look
                    continue
                seen.add((d1, d2))
                place, h, first, last = anchors(t.encode("utf-8", "surrogatepass"), length, gram)
                out.append((h, np.full(len(h), d1), np.full(len(h), d2), place))
            if out:
                h, d1, d2, at = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"h": h, "d1": d1, "d2": d2, "at": at})

    return run


def _cut_out(length, gram):
    """Of a text and the places of its repeated anchors, a row for each: its strings and their bytes."""

    columns = ["key", "hot", "d1", "d2", "at", "low", "high", "bytes"]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                raw = r.text.encode("utf-8", "surrogatepass")
                place, h, first, last = anchors(raw, length, gram)
                again = np.isin(place, np.asarray(r.again, np.int64))
                hot = np.isin(place, np.asarray(r.hot, np.int64))
                for k in np.flatnonzero(again).tolist():
                    s, e, p = int(first[k]), int(last[k]), int(place[k])
                    out.append((int(h[k]), bool(hot[k]), r.d1, r.d2, p, p - e, p - s, raw[s : e + length]))
            yield pd.DataFrame(out, columns=columns)

    return run


def _shard(rows, length):
    """rows: bytes, low, high, n. Occurrences for marked(); the anchor stands `high` bytes into the bytes."""
    return [(x[h:], x[:h][::-1], lo, h, n) for x, lo, h, n in rows]


def _keyed(pdf, keys):
    """Consecutive rows of pdf with the same keys."""
    k = pdf[keys].to_numpy()
    cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]).tolist() if len(pdf) else []
    yield from zip(cut, [*cut[1:], len(pdf)])


_MARKS, _GROUPS = "lo int, hi int", "g string, left int, size int"


def _scan(length, keys, refs, groups=False):
    """Whole shards from rows sorted by key; a batch's last shard waits for the next batch. For each occurrence the
    reaches at which it is repeated, or with `groups` the maximal repeats that it is in, named by their bytes."""

    def scanned(pdf):
        out = []
        ref = [pdf[c].tolist() for c in refs]
        parts = list(zip(pdf.bytes.tolist(), pdf.low.tolist(), pdf.high.tolist(), pdf.n.tolist()))
        for a, b in _keyed(pdf, keys):
            if b - a == 1 and parts[a][3] == 1:
                continue
            shard = _shard(parts[a:b], length)
            if groups:
                for left, right, members in grouped(shard, length):
                    x = shard[members[0]]
                    g = hashlib.md5(x[1][:left][::-1] + x[0][:right]).hexdigest()
                    out += [(*(c[a + i] for c in ref), g, left, left + right) for i in members]
                continue
            for i, spans in enumerate(marked(shard, length)):
                out += [(*(c[a + i] for c in ref), lo, hi) for lo, hi in spans]
        return pd.DataFrame(out, columns=[*refs, *(["g", "left", "size"] if groups else ["lo", "hi"])])

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            held = pdf[last]
            if not last.all():
                yield scanned(pdf[~last].reset_index(drop=True))
        if held is not None and len(held):
            yield scanned(held.reset_index(drop=True))

    return run


def _digest(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts), digest_size=8).digest(), signed=True)


def _halved(length):
    """A large shard's contexts in two shards each: reaches up to mid - 1, and from mid on, keyed by the
    bytes that their strings must share. from_, to: the reaches of the shard."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mid = (r.from_ + r.to + 1) // 2
                for a, b in ((r.from_, mid - 1), (mid, r.to)):
                    lo, hi = max(r.low, a), min(r.high, b)
                    if lo <= hi:
                        p = r.high
                        shared = r.bytes[p - a : p + length - b]
                        out.append((r.c1, r.c2, _digest(r.key, a, b, shared), a, b, lo, hi, r.bytes[p - hi : p - lo + length], r.n))
            yield pd.DataFrame(out, columns=["up1", "up2", "key", "from_", "to", "low", "high", "bytes", "n"])

    return run


_CONTEXT = ["key", "from_", "to", "low", "high", "bytes"]


def _named(df: DataFrame, as_: tuple[str, str] = ("c1", "c2")) -> DataFrame:
    return df.withColumns({as_[0]: F.xxhash64("key", "low", "bytes"), as_[1]: F.xxhash64(F.lit(1), "key", "low", "bytes")})


def _ranges(contexts: DataFrame, length: int, capacity: int, groups: bool = False) -> DataFrame:
    """Distinct contexts (c1, c2) with counts n -> (c1, c2, lo, hi): reaches at which their strings are repeated; or
    (c1, c2, g, left, size): the groups that they are in."""
    contexts = stored(contexts, "contexts")
    sizes = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.max("from_").alias("from_"), F.max("to").alias("to"))
    single = F.col("from_") == F.col("to")
    sizes = stored(sizes.filter("all > 1").select("key", ((F.col("m") > capacity) & ~single).alias("large"), single.alias("single")), "shards")
    of = lambda condition: contexts.join(sizes.filter(condition).select("key"), "key", "left_semi")
    # a context of one reach is one string, and equal ones have been counted together, byte by byte
    string = [F.md5("bytes").alias("g"), F.col("low").alias("left"), F.lit(length).alias("size")]
    single = of("single").filter("n > 1").select("c1", "c2", *(string if groups else [F.col("low").alias("lo"), F.col("high").alias("hi")]))
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = of("NOT large AND NOT single").repartition(parts, "key").sortWithinPartitions("key")
    found = whole.mapInPandas(_scan(length, ["key"], ["c1", "c2"], groups), f"c1 long, c2 long, {_GROUPS if groups else _MARKS}").union(single)
    if sizes.filter("large").isEmpty():
        return found
    halves = stored(_named(of("large").mapInPandas(_halved(length), "up1 long, up2 long, key long, from_ int, to int, low int, high int, bytes binary, n long")), "halves")
    # what was cut off may have been all that told contexts apart: equal ones go on as one
    below = _ranges(_named(halves.groupBy(*_CONTEXT).agg(F.sum("n").alias("n"))), length, capacity, groups)
    up = halves.select("up1", "up2", "c1", "c2").join(below, ["c1", "c2"]).select(F.col("up1").alias("c1"), F.col("up2").alias("c2"), *below.columns[2:])
    return found.union(up)


def _hot_ranges(hot: DataFrame, length: int, gram: int, capacity: int, groups: bool = False) -> DataFrame:
    """Ranges or groups of the distinct contexts of large shards. At most log2(length) halvings."""
    whole = hot.select("key", F.lit(0).alias("from_"), F.lit(length - gram).alias("to"), "low", "high", "bytes")
    return stored(_ranges(_named(whole.groupBy(*_CONTEXT).agg(F.count(F.lit(1)).alias("n"))), length, capacity, groups), "hot-ranges")


def _repeated(texts: DataFrame, length: int, gram: int, shard_capacity: int, groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """texts(d1, d2, text) -> distinct texts with repeated anchors, and for each place of such an anchor (d1, d2, at) what
    _scan gives for it."""
    found = stored(texts.mapInPandas(_find(length, gram), "h long, d1 long, d2 long, at long"), "anchors")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", (F.col("n") > shard_capacity).alias("hot"))
    counts = stored(counts, "counts")  # read anew, so that Spark can split the join at a hot anchor
    again = (
        found.join(counts, "h")
        .groupBy("d1", "d2")
        .agg(F.collect_set("at").alias("again"), F.collect_set(F.when(F.col("hot"), F.col("at"))).alias("hot"))
    )
    candidates = stored(texts.dropDuplicates(["d1", "d2"]).join(again, ["d1", "d2"]), "candidates")
    rows = stored(candidates.mapInPandas(_cut_out(length, gram), "key long, hot boolean, d1 long, d2 long, at long, low int, high int, bytes binary"), "occurrences")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool = rows.filter("NOT hot").select("key", "d1", "d2", "at", "low", "high", "bytes", F.lit(1).alias("n"))
    scanned = f"d1 long, d2 long, at long, {_GROUPS if groups else _MARKS}"
    ranges = cool.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_scan(length, ["key"], ["d1", "d2", "at"], groups), scanned)
    hot = rows.filter("hot")
    if not hot.isEmpty():
        places = _named(hot).select("d1", "d2", "at", "c1", "c2")
        ranges = ranges.union(places.join(_hot_ranges(hot, length, gram, shard_capacity, groups), ["c1", "c2"]).select(*ranges.columns))
    return candidates, ranges


def repeat_ranges(texts: DataFrame, length: int = 200, gram: int = 32, shard_capacity: int = 512) -> DataFrame:
    """texts(d1, d2, text) -> (d1, d2, text, ranges): for each distinct text with repeated anchors, the places
    [from, to] at which strings of `length` bytes start that also start elsewhere in distinct texts."""
    candidates, ranges = _repeated(texts, length, gram, shard_capacity)
    starts = ranges.select("d1", "d2", F.struct((F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo")).alias("b")).alias("r"))
    return candidates.select("d1", "d2", "text").join(starts.groupBy("d1", "d2").agg(F.collect_set("r").alias("ranges")), ["d1", "d2"])


def _removed(length):
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                raw = r.text.encode("utf-8", "surrogatepass")
                gone = np.zeros(len(raw) + 1, np.int64)
                for x in r.ranges:
                    gone[x["a"]] += 1
                    gone[x["b"] + length] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((r.d1, r.d2, int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1)), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["d1", "d2", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, shard_capacity: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of `length` bytes that also starts anywhere else, in this document or
    another, goes. Texts with an equal one (repeated rows too) go whole if they have `length` bytes; shorter,
    empty and null texts lose nothing. length <= 256 + gram - 1 and gram a power of two. Texts are told
    apart by 128 bits of hash. Rows are never told apart by doc_id, so null or repeated ids need no rule.
    """
    assert gram & (gram - 1) == 0 and gram <= length
    kind = dict(docs.dtypes)[id_col]
    rows = chosen(docs, id_col, text_col).withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    n_bytes = F.octet_length("text").cast("long")
    # parts of the result that need no text later are taken now
    known = stored(rows.select("doc_id", "d1", "d2", n_bytes.alias("n_bytes"), F.sha2("text", 256).alias("sha")), "documents")
    copies = known.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"))
    some = repeat_ranges(rows.filter(n_bytes >= length).select("d1", "d2", "text"), length, gram, shard_capacity)
    found = stored(some.mapInPandas(_removed(length), "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string"), "removed")
    by_text = stored(copies.join(found, ["d1", "d2"], "left"), "by-text")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return known.join(by_text, ["d1", "d2"]).select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


@F.pandas_udf(LongType())
def _agreed(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whole bytes in which two hexadecimal strings begin alike."""
    return pd.Series([_common(x.encode(), y.encode()) // 2 for x, y in zip(a, b)], dtype="int64")


def _widened(groups: DataFrame, places: DataFrame, texts: DataFrame, chunk: int = 256) -> DataFrame:
    """groups(g, size), places(g, d1, d2, start), texts(d1, d2, text) -> (g, before, after): by how many bytes all
    occurrences of a group agree on either side. What a set of strings has in common is what the smallest and the largest
    have, so a group is two strings a task and never gathered. Eight times the bytes go to the next round, for the groups alone
    that agree in all of them."""
    done, before, after = None, F.lit(0).cast("long"), F.lit(0).cast("long")
    active = groups.select("g", "size", before.alias("before"), after.alias("after"))
    while True:
        raw, start, end = F.col("text").cast("binary"), F.col("start") - F.col("before"), F.col("start") + F.col("size") + F.col("after")
        left = F.reverse(F.hex(F.substring(raw, F.greatest(start - chunk, F.lit(0)).cast("int") + 1, F.least(start, F.lit(chunk)).cast("int"))))
        right = F.hex(F.substring(raw, end.cast("int") + 1, F.lit(chunk)))
        sides = places.join(active, "g").join(texts, ["d1", "d2"]).select("g", "size", "before", "after", left.alias("l"), right.alias("r"))
        ends = sides.groupBy("g", "size", "before", "after").agg(F.min("l").alias("l0"), F.max("l").alias("l1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
        more = stored(ends.select("g", "size", "before", "after", _agreed("l0", "l1").alias("dl"), _agreed("r0", "r1").alias("dr")), "widened")
        found = more.select("g", "size", (F.col("before") + F.col("dl")).alias("before"), (F.col("after") + F.col("dr")).alias("after"), ((F.col("dl") == chunk) | (F.col("dr") == chunk)).alias("on"))
        ended = found.filter("NOT on").drop("on", "size")
        done = ended if done is None else done.union(ended)
        active, chunk = found.filter("on").drop("on"), 8 * chunk
        if active.isEmpty():
            return done


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, shard_capacity: int = 512) -> DataFrame:
    """Groups of repeats of at least `length` bytes, a row for each occurrence: group, size (bytes), n (occurrences in distinct
    texts), doc_id (the smallest of the documents with this text), copies (their number), start (byte).

    A group stands for the strings of `length` bytes that start again with the same occurrences, but for a shift: its string
    is as long as all these agree on either side (a maximal repeat), and all places of that string are there. So each repeated string
    of `length` bytes is in exactly one group that has just its occurrences; a maximal repeat whose occurrences no such string has
    alone, being only what larger groups have in common, is not a group. The result does not depend on `shard_capacity`.
    Equal texts of `length` bytes or more are also a group of their own, of one row: n is 1, copies their number. Null texts count
    as empty, shorter texts are in no group; a text whose ids are all null has a null doc_id.
    """
    assert gram & (gram - 1) == 0 and gram <= length
    kind = dict(docs.dtypes)[id_col]
    rows = chosen(docs, id_col, text_col).filter(F.octet_length("text") >= length).withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    known = stored(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).cast("long").alias("bytes")), "texts")
    texts, scanned = _repeated(rows.select("d1", "d2", "text"), length, gram, shard_capacity, groups=True)
    places = stored(scanned.select("g", F.col("size").cast("long").alias("size"), "d1", "d2", (F.col("at") - F.col("left")).alias("start")), "places")
    first = places.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min(F.struct("d1", "d2", "start")).alias("f"))
    # groups of the same occurrences but for a shift have the same distances from their first ones
    away = F.col("start") - F.col("f.start")
    alike = places.drop("size").join(first, "g").groupBy("g", "n", "size", "f").agg(F.bit_xor(F.xxhash64("d1", "d2", away)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "d1", "d2", away)).alias("s2"))
    family = ["s1", "s2", "n", "d1", "d2"]
    alike = alike.select("g", "s1", "s2", "n", "size", "f.*")
    line = Window.partitionBy(*family).orderBy("start", "size", "g")
    reached = F.max(F.col("start") + F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = alike.withColumn("new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(line))
    joined = stored(runs.groupBy(*family, "run").agg(F.min_by("g", F.struct("start", "size", "g")).alias("g"), F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end")), "runs")
    joined = joined.select(*family, "g", "start", (F.col("end") - F.col("start")).alias("size"))
    wide = joined.join(_widened(joined.select("g", "size"), places.select("g", "d1", "d2", "start"), texts), "g")
    # runs of one family that were widened to the same string are one group
    wide = wide.withColumns({"first": F.col("start") - F.col("before"), "size": F.col("size") + F.col("before") + F.col("after")})
    final = wide.groupBy(*family, "first", "size").agg(F.min(F.struct("g", "before")).alias("m")).select("n", "size", "m.*")
    inside = places.drop("size").join(final, "g").join(known, ["d1", "d2"]).select(F.col("g").alias("group"), "size", "n", F.col("doc_id").cast(kind).alias("doc_id"), "copies", (F.col("start") - F.col("before")).alias("start"))
    whole = known.filter("copies > 1").select(F.concat(F.lit("text-"), F.hex("d1"), F.hex("d2")).alias("group"), F.col("bytes").alias("size"), F.lit(1).cast("long").alias("n"), F.col("doc_id").cast(kind).alias("doc_id"), "copies", F.lit(0).cast("long").alias("start"))
    return inside.union(whole)


def query(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))
