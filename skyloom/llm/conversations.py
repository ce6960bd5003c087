"""Repair of conversations' structure: a dynamic programme over sequences compressed by a grammar.

Every row becomes a symbol of its role and fault. Re-Pair gives the most frequent neighbouring symbols of all
conversations together a rule, round upon round. Each symbol and rule has one min-plus transfer matrix: the cheapest
edits that lead from a state of the target form before its rows to a state behind them, with the edits' initials as a rope,
whose parts are shared. A rule's matrix is the product of its two parts', worked out once and used in all
conversations that the rule stands in.

States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row. Repaired conversations end
in 0 or 3. Of two cheapest ways the one whose initials are ASCII-least counts; one can't be the beginning of the other,
for inserts cost, so the least way of a product is a product of least ways.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import numbered
from .common import stored

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
BLOCK_BITS = 12  # rows of a conversation that one symbol sequence holds, as a power of two
_ROLES, _STEP, _ENDS = "suao", (2, 2, 3, 2), (0, 3)
_NAMES = ("user", "user", "assistant", "user")  # of the role that a state wants next


def compared(a, b) -> int:
    """Order of two ropes (texts, or (left, right) of ropes) as texts; parts that are one object are passed over."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, tuple):
            left += (x[1], x[0])
            right.append(y)
        elif isinstance(y, tuple):
            right += (y[1], y[0])
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return -1 if x[:n] < y[:n] else 1
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
    return bool(left) - bool(right)


def flat(rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += (x[1], x[0])
        else:
            out.append(x)
    return "".join(out)


_order = cmp_to_key(lambda a, b: a[0] - b[0] or compared(a[1], b[1]))


def least(ways: list):
    """The cheapest (cost, rope), then the ASCII-least; None of none."""
    return min(ways, key=_order, default=None) if len(ways) != 1 else ways[0]


def product(a: list, b: list) -> list:
    """Of two matrices: rows are states before, columns states behind, cells (cost, rope) or None."""
    out = []
    for row in a:
        cells = []
        for q in range(4):
            ways = [(x[0] + b[k][q][0], k) for k, x in enumerate(row) if x and b[k][q]]
            low = min((c for c, _ in ways), default=None)
            cells.append(least([(low, (row[k][1], b[k][q][1])) for c, k in ways if c == low]))
        out.append(cells)
    return out


def inserted(state: int) -> list:
    """(cost, initials, state) of inserts one after another, while they lead to a new state."""
    out, seen, cost, text = [], set(), 0, ""
    while state not in seen:
        out.append((cost, text, state))
        seen.add(state)
        cost, text, state = cost + INSERT, text + "I", _STEP[state]
    return out


def terminal(symbol: int) -> tuple:
    """Matrix and counts of a row: symbol = 4 * role (of "suao") + fault (0 none, 1 truncated, 2 blank, 3 duplicate)."""
    role, fault = _ROLES[symbol // 4], symbol % 4
    matrix = []
    for before in range(4):
        ways: list[list] = [[], [], [], []]
        for cost, text, s in inserted(before):
            ways[s].append((cost + DELETE, text + "D"))
            if fault < 2:
                more = cost + fault * TRUNCATED
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, s))
                if kept:
                    ways[kept].append((more + KEEP, text + "K"))
                ways[_STEP[s]].append((more + REROLE, text + "R"))
        matrix.append([least(w) for w in ways])
    return matrix, (int(fault == 2), int(fault == 3), int(fault == 1), 0, role, role)


def joined(a: tuple, b: tuple) -> tuple:
    """(blank, duplicate, truncated, illegal, first role, last role) of two stretches, one after the other."""
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3] + (a[5] + b[4] not in ("su", "ua", "au")), a[4], b[5]


def symbol_char(role: Column, blank: Column, copy: Column, truncated: Column) -> Column:
    """A row's symbol as a letter from A on."""
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(blank, 2).when(copy, 3).when(truncated, 1).otherwise(0)
    return F.substring(F.lit("ABCDEFGHIJKLMNOP"), place * 4 + fault + 1, F.lit(1))


class Grammar:
    """Rules by rounds; a round's rules hold only older symbols."""

    def __init__(self):
        self.rounds: list[dict[tuple[int, int], tuple[int, int]]] = []  # pair to (rank, symbol)
        self.pairs: list[tuple[int, int]] = []

    def add(self, pairs: list[tuple[int, int]]) -> None:
        self.rounds.append({p: (k, 16 + len(self.pairs) + k) for k, p in enumerate(pairs)})
        self.pairs += pairs

    def parse(self, sequence: str) -> list[int]:
        """The sequence's symbols once all rules are applied, the more frequent pairs of a round first."""
        x = [ord(c) - 65 for c in sequence]
        for rules in self.rounds:
            hits = sorted((*rules[p], i) for i, p in enumerate(zip(x, x[1:])) if p in rules)
            if not hits:
                continue
            used, new = bytearray(len(x)), {}
            for _, symbol, i in hits:
                if not used[i] and not used[i + 1]:
                    used[i] = used[i + 1] = 1
                    new[i] = symbol
            x = [new.get(i, s) for i, s in enumerate(x) if not (i and i - 1 in new)]
        return x

    def evaluated(self) -> list[tuple]:
        """Matrix and counts of every symbol, from the bottom up."""
        known = [terminal(s) for s in range(16)]
        for a, b in self.pairs:
            known.append((product(known[a][0], known[b][0]), joined(known[a][1], known[b][1])))
        return known


def pair_counts(x: list[int]) -> Counter:
    """Neighbours in x; of a run of one symbol every second place only."""
    out, before, taken = Counter(), None, False
    for p in zip(x, x[1:]):
        taken = p == before and p[0] == p[1] and not taken
        if not taken:
            out[p] += 1
        before = p
    return out


def learn(sequences: DataFrame, rules_per_round: int = 1024, rounds: int = BLOCK_BITS, least_count: int = 2) -> Grammar:
    """Re-Pair over sequences(seq, n), n their occurrences. Each round counts all neighbours of the whole table and gives the
    most frequent ones a rule; sequences halve at best, so `rounds` are enough for those of 2^rounds rows. The bounds limit
    what is shared, never a result: symbols without a rule are multiplied out."""
    grammar = Grammar()
    for _ in range(rounds):

        def counted(batches, g=grammar):
            for pdf in batches:
                c: Counter = Counter()
                for s, n in zip(pdf.seq, pdf.n):
                    for p, m in pair_counts(g.parse(s)).items():
                        c[p] += n * m
                yield pd.DataFrame([(a, b, m) for (a, b), m in c.items()], columns=["a", "b", "m"]).astype("int64")

        pairs = sequences.select("seq", "n").mapInPandas(counted, "a long, b long, m long").groupBy("a", "b").agg(F.sum("m").alias("m"))
        found = pairs.filter(F.col("m") >= least_count).orderBy(F.desc("m"), "a", "b").limit(rules_per_round).collect()
        if not found:
            break
        grammar.add([(r.a, r.b) for r in found])
    return grammar


def multiplied(parts: list, starts: list[int]) -> tuple[list, tuple]:
    """Rows `starts` of the product of matrices with counts, halves first so that ropes stay shallow."""
    parts = [([m[p] for p in starts], c) if not i else (m, c) for i, (m, c) in enumerate(parts)]
    while len(parts) > 1:
        parts = [(product(parts[i][0], parts[i + 1][0]), joined(parts[i][1], parts[i + 1][1])) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_CELLS = "blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"


def _evaluated(grammar: Grammar):
    def run(batches):
        known = grammar.evaluated()
        for pdf in batches:
            out = []
            for s, head in zip(pdf.seq, pdf["head"]):
                matrix, counts = multiplied([known[x] for x in grammar.parse(s)], [0] if head else [0, 1, 2, 3])
                cells = [c for row in matrix for c in row]
                out.append((s, bool(head), *counts, [c and c[0] for c in cells], [c and flat(c[1]) for c in cells]))
            yield pd.DataFrame(out, columns=["seq", "head", *(x.split()[0] for x in _CELLS.split(", "))])

    return run


class _Conversation:
    """What a task holds of the conversation whose rows it reads: sums, and one way to each state."""

    def __init__(self, conv, gaps):
        self.conv, self.gaps, self.counts, self.ways = conv, gaps, None, [(0, ""), None, None, None]

    def block(self, counts, costs, audits):
        rows = [[None if c is None else (c, a) for c, a in zip(costs[i : i + 4], audits[i : i + 4])] for i in range(0, len(costs), 4)]
        if self.counts is None:
            self.ways, self.counts = rows[0], counts
        else:
            self.ways, self.counts = [c and (c[0], flat(c[1])) for c in product([self.ways], rows)[0]], joined(self.counts, counts)

    def decided(self):
        """Cost and initials, inserts at the end included."""
        ends = [(w[0] + c, w[1] + t) for q, w in enumerate(self.ways) if w for c, t, s in inserted(q) if s in _ENDS]
        return least(ends)


class _Editor:
    """Applies a conversation's edits to its rows, which come one by one: yields the repaired rows."""

    def __init__(self, audit):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", _NAMES[self.state], ""
            self.at, self.state = self.at + 1, _STEP[self.state]

    def row(self, role, text):
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield edit, role, text
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        elif edit == "R":
            yield edit, _NAMES[self.state], text
            self.state = _STEP[self.state]

    def end(self):
        yield from self._inserts()


_COLUMNS = ["conv", "kind", "gaps", "block", "costs", "audits", "blank", "duplicate", "truncated", "illegal", "first", "last", "role", "text"]


def _finished(conv_type, as_rows: bool, schema: pa.Schema, batch_chars: int = 1 << 22):
    """Rows of whole conversations in order: what is known of it, its blocks, its texts. Nothing of it is kept but the edits."""

    def run(batches):
        now, editor, sha, n, place = None, None, None, 0, 0
        out, chars = [], 0

        def put(*row):
            nonlocal chars
            out.append(row)
            chars += sum(len(x) for x in row if isinstance(x, str)) + 64

        def take(edited):
            nonlocal place
            for edit, role, text in edited:
                if as_rows:
                    put(now.conv, place, role, text, edit)
                else:
                    sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                place += 1

        def start():
            nonlocal editor, sha, place
            cost, audit = now.decided()
            editor, sha, place = _Editor(audit), hashlib.sha256(), 0
            return cost, audit

        def finish():
            if now is None:
                return
            cost, audit = start() if editor is None else found
            take(editor.end())
            if not as_rows:
                put(now.conv, n, now.gaps, *(now.counts or (0, 0, 0, 0))[:4], cost, audit, sha.hexdigest())

        def packed():
            nonlocal out, chars
            made = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
            out, chars = [], 0
            return made

        for batch in batches:
            for conv, kind, gaps, _, costs, audits, b, d, t, i, first, last, role, text in zip(*(c.to_pylist() for c in batch.select(_COLUMNS).columns)):
                if kind == 0:
                    finish()
                    now, editor, n = _Conversation(conv, gaps), None, 0
                elif kind == 1:
                    now.block((b, d, t, i, first, last), costs, audits)
                else:
                    if editor is None:
                        found = start()
                    n += 1
                    take(editor.row(role, text))
                if chars > batch_chars:
                    yield packed()
        finish()
        yield packed()

    return run


def _repair(rows: DataFrame, conversations: DataFrame | None, as_rows: bool, conv_col: str, turn_col: str, role_col: str, text_col: str, bounds: dict) -> DataFrame:
    kind = dict(rows.dtypes)[conv_col]
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    d = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    d = d.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    text = F.rtrim("text", F.lit(BLANKS))
    thin = stored(d.select("conv", "turn", "role", "h1", "h2", (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated")), "turns")
    order = ["turn", "role", "h1", "h2"]
    placed = stored(numbered(thin, order, by=["conv"], name="place"), "placed")
    seen = placed.groupBy("conv", "role", "h1", "h2").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    seen = seen.select(*(F.col(c).alias(f"_{c}") for c in ("conv", "role", "h1", "h2")), "earliest")
    same = placed["conv"].eqNullSafe(seen["_conv"]) & (placed["role"] == seen["_role"]) & (placed["h1"] == seen["_h1"]) & (placed["h2"] == seen["_h2"])
    marked = placed.join(seen, same, "left")
    copy = F.coalesce(F.col("place") > F.col("earliest"), F.lit(False))
    marked = marked.select("conv", "place", symbol_char(F.col("role"), F.col("blank"), copy, F.col("truncated")).alias("symbol"))
    # at most 2^BLOCK_BITS rows of a conversation meet here, however long it is
    blocks = marked.groupBy("conv", F.shiftright("place", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "symbol"))).alias("s"))
    blocks = stored(blocks.select("conv", "block", F.array_join(F.col("s.symbol"), "").alias("seq"), (F.col("block") == 0).alias("head")), "blocks")
    sequences = stored(blocks.groupBy("seq", "head").agg(F.count(F.lit(1)).alias("n")), "sequences")
    grammar = learn(sequences, **bounds)
    cells = stored(sequences.select("seq", "head").mapInPandas(_evaluated(grammar), "seq string, head boolean, " + _CELLS), "cells")

    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    gaps = thin.groupBy("conv").agg(span.alias("gaps"))
    if conversations is not None:
        every = conversations.select(F.col(f"`{conv_col}`").alias("_conv")).distinct()
        gaps = every.join(gaps, every["_conv"].eqNullSafe(gaps["conv"]), "left").select(F.col("_conv").alias("conv"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    parts = gaps.select("conv", F.lit(0).alias("kind"), "gaps")
    parts = parts.unionByName(blocks.join(cells, ["seq", "head"]).drop("seq", "head").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = parts.unionByName(d.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    parts = parts.repartition("conv").sortWithinPartitions("conv", "kind", "block", *order).select(*_COLUMNS)
    if as_rows:
        made = f"conv {kind}, place long, role string, text string, edit string"
    else:
        made = f"conv {kind}, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = parts.mapInArrow(_finished(kind, as_rows, to_arrow_schema(StructType.fromDDL(made))), made)
    return out.withColumnRenamed("conv", conv_col)


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **bounds: int) -> DataFrame:
    """One row per conversation of `rows`, and of `conversations` (a column of their ids) if given: conv_id, n_rows, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows stand by turn, nulls first; those of one turn by role, then by a hash of role and text, so equal ones are
    neighbours. Null roles and texts are one space; rows with a null conversation are one conversation. Rows are told apart
    by 128 bits of hash. A conversation of any number of rows is cut in blocks of 4096, whose matrices are
    multiplied; its texts pass through one task, one by one, as their digest asks, but are not held there. Conversations without
    rows have zeros, no edits and the digest of nothing. An empty table gives an empty result. bounds: those of `learn`."""
    return _repair(rows, conversations, False, conv_col, turn_col, role_col, text_col, bounds)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **bounds: int) -> DataFrame:
    """The conversations as `repair` mends them: conv_id, place (from 0), role, text and edit (K kept, R role changed, I inserted)."""
    return _repair(rows, None, True, conv_col, turn_col, role_col, text_col, bounds)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults by crc32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text, 2 takes . ! ? out of it,
    3 repeats it, 4 makes its role user. A null counts as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(filled("conv_id"), F.lit(":"), filled("turn")), "utf-8")) % 20
    d = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows), rows.select("conv_id"))
