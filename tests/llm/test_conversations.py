"""Repaired conversations against a plain programme over rows and whole strings."""

import hashlib
import random
import re
import zlib
from itertools import product as all_of

import pytest

from skyloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, place int"


def brute_repair(rows):
    """rows in order: (blank, duplicate, truncated, illegal, cost, audit, repaired)."""
    seen, faults = set(), []
    for role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = lambda s, r: {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, r))
    best = {"0": (0, "", [])}

    def inserts(ways):
        more = True
        while more:
            more = False
            for s, (c, a, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    t = step(s, role[0])
                    way = (c + 3, a + "I", [*out, (role, "")])
                    if t and (t not in ways or way[:2] < ways[t][:2]):
                        ways[t], more = way, True
        return ways

    for (role, text), fault in zip(rows, faults):
        after = {}

        def offer(t, way):
            if t and (t not in after or way[:2] < after[t][:2]):
                after[t] = way

        for s, (c, a, out) in inserts(best).items():
            offer(s, (c + 4, a + "D", out))
            if fault in ("", "truncated"):
                c += 3 * (fault == "truncated")
                offer(step(s, role[:1]), (c, a + "K", [*out, (role, text)]))
                for new in ("user", "assistant"):
                    offer(step(s, new[0]), (c + 3, a + "R", [*out, (new, text)]))
        best = after
    cost, audit, out = min((w for s, w in inserts(best).items() if s in "0a"), key=lambda w: w[:2])
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, out)


def every_way(rows, most_inserts=3):
    """Cost and audit by trying all edits."""
    faults, best = brute_faults(rows), None
    for edits in all_of("KRD", repeat=len(rows)):
        for roles in all_of(*(["user", "assistant"] if e == "R" else [""] for e in edits)):
            if any(e != "D" and f == 2 for e, f in zip(edits, faults)):
                continue
            cost = sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (f == 1 and e != "D") for e, f in zip(edits, faults))
            line = [(e, (r or role)[:1]) for e, r, (role, _) in zip(edits, roles, rows)]
            todo = [(line, 0)]
            for _ in range(most_inserts + 1):
                for x, n in todo:
                    if re.fullmatch(r"(s?(ua)+)?", "".join(r for e, r in x if e != "D")):
                        way = (cost + 3 * n, "".join(e for e, _ in x))
                        best = way if best is None or way < best else best
                todo = [([*x[:i], ("I", r), *x[i:]], n + 1) for x, n in todo for i in range(len(x) + 1) for r in "ua"]
    return best


def brute_faults(rows):
    b = [0] * len(rows)
    for i, (role, text) in enumerate(rows):
        t = text.rstrip(C.BLANKS)
        b[i] = 2 if not t or (role, text) in rows[:i] else int(t[-1] not in ".!?")
    return b


def test_brute_force_is_the_cheapest_of_all_ways():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(0, 3))]
        assert brute_repair(rows)[4:6] == every_way(rows, 2 if len(rows) == 3 else 3), rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def check(got, by_conv, spark_order=None):
    got = {r.conv_id: r for r in got}
    assert set(got) == set(by_conv)
    for conv, rows in by_conv.items():
        blank, dup, trunc, illegal, cost, audit, out = brute_repair([r[1:3] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        r = got[conv]
        assert (r.n_rows, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (len(rows), gaps, blank, dup, trunc, illegal, cost, audit, digest), (conv, rows, r)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by_conv = {r.conv_id: [] for r in rows}
    for r in rows:
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", r.text) if k == 2 else r.text
        by_conv[r.conv_id] += [(r.turn, "user" if k == 4 else r.role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    check(C.query(spark, sf).collect(), {c: in_order(x) for c, x in by_conv.items()})


def random_rows(rng, conv, n):
    texts = ["Yes.", "No!", "and so", " ", "", "why?\n", "x" * 50, "é.", "1."]
    return [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "U", ""]), f"{rng.choice(texts)}" if rng.random() < 0.5 else f"text {rng.random()}.") for t in range(n)]


@pytest.mark.parametrize("bits,bounds", [(12, {}), (2, {}), (1, {"rules_per_round": 2}), (0, {"rounds": 1}), (3, {"least_count": 10**9})])
def test_blocks_and_rules_change_nothing(spark, monkeypatch, bits, bounds):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = [r for c in range(40) for r in random_rows(rng, c, rng.choice([0, 1, 2, 3, 5, 8, 30]))]
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t, role, text))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    check(C.repair(df, **bounds).collect(), by_conv)


def test_one_long_conversation(spark):
    rng = random.Random(5)
    rows = random_rows(rng, None, 20_000) + random_rows(rng, 7, 3)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(8)
    check(C.repair(df).collect(), {c: [r[1:] for r in rows if r[0] == c] for c in (None, 7)})


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "a."), (1, 0, "assistant", "b."), (1, 9, "user", None), (1, 9, None, "c."), (1, 9, None, "c."),
        (2, None, None, None), (None, 3, "user", "x" * 1_000_000), (None, -2, "system", "s."), (3, 1, "", "t."), (4, 5, "assistant", "\x0b\x1f"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    want = {1: [(None, "user", "a."), (0, "assistant", "b."), (9, " ", "c."), (9, " ", "c."), (9, "user", " ")], 2: [(None, " ", " ")], None: [(-2, "system", "s."), (3, "user", "x" * 1_000_000)], 3: [(1, "", "t.")], 4: [(5, "assistant", "\x0b\x1f")]}
    check(C.repair(df).collect(), want)
    more = spark.createDataFrame([(1,), (50,), (None,)], "conv_id long")
    got = {r.conv_id: r for r in C.repair(df.filter("conv_id = 1"), more).collect()}
    assert got.keys() == {1, 50, None} and got[50].audit == "" and got[50].cost == got[50].gaps == got[None].illegal == 0
    assert got[50].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert C.repair(df.limit(0)).count() == 0
    clash = df.selectExpr("conv_id", "turn", "role", "text", "1 AS block", "2 AS kind", "3 AS h1", "4 AS conv", "5 AS gaps")
    check(C.repair(clash).collect(), want)


def test_repaired_rows(spark):
    rng = random.Random(3)
    rows = [r for c in range(20) for r in random_rows(rng, c, 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    out = C.repaired_rows(df).collect()
    for c in range(20):
        mine = sorted((r for r in out if r.conv_id == c), key=lambda r: r.place)
        _, _, _, _, _, audit, want = brute_repair([r[2:] for r in rows if r[0] == c])
        assert [(r.role, r.text) for r in mine] == want and "".join(r.edit for r in mine) == audit.replace("D", "")


def test_damage_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, 0), (5, None, "user", "q?", 0)], SCHEMA)
    got = {r.conv_id: (r.role, r.text) for r in C.damaged(df).collect()}
    for conv, key, role, text in [(None, " : ", " ", " "), (5, "5: ", "user", "q?")]:
        k = zlib.crc32(key.encode()) % 20
        want = None if k == 0 else ("user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        assert got.get(conv) == want


def test_grammar_shares_rules():
    g = C.Grammar()
    g.add([(4, 8), (8, 4)])
    g.add([(16, 16)])
    assert g.parse("EIEIEIEIA") == [18, 18, 0]
    known = g.evaluated()
    assert known[18][0][0][3] and C.flat(known[18][0][0][3][1]) == "KKKK" and known[18][0][0][3][0] == 0
    assert C.pair_counts([1, 1, 1, 1, 1, 2]) == {(1, 1): 2, (1, 2): 1}
