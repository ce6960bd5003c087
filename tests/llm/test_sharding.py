"""The permutation against a plain loop, and shards against their law."""

import zlib

import numpy as np
import pytest

from skyloom.llm import sharding
from skyloom.llm.sharding import Feistel, locate, row_at, shuffled_shards, write_shards

ALL = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def loop_place(i, n, seed, rounds=6):
    half = 1
    while 1 << 2 * half < n:
        half += 1
    mask = (1 << half) - 1
    while True:
        a, b = i >> half, i & mask
        for r in range(rounds):
            a, b = b, a ^ (mixed(b ^ mixed((seed + (r + 1) * 0x9E3779B97F4A7C15) & ALL)) & mask)
        i = b << half | a
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    p = Feistel(n, 9).place(x)
    assert sorted(p) == list(range(n)) and (Feistel(n, 9).number(p) == x).all()
    assert p.tolist() == [loop_place(i, n, 9) for i in range(n)]
    shard, slot = locate(x, n, 7, 9)
    assert (row_at(shard, slot, n, 7, 9) == x).all()
    if n >= 100:
        assert (Feistel(n, 8).place(x) != p).mean() > 0.9 and abs(np.corrcoef(x, p)[0, 1]) < 0.3


def test_large_numbers():
    n = (1 << 40) + 12_345
    x = np.random.default_rng(0).integers(0, n, 2000)
    p = Feistel(n, 1).place(x)
    assert (p < n).all() and len(set(p)) == len(set(x)) and (Feistel(n, 1).number(p) == x).all()
    assert p[:20].tolist() == [loop_place(int(i), n, 1) for i in x[:20]]
    assert len(Feistel(0).place(np.zeros(0, int))) == 0


def rows(df):
    return [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()]


def check(df, out, shards, seed):
    got, n = out.collect(), df.count()
    assert sorted(r.row_number for r in got) == list(range(n))
    raw = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in df.select("doc_id", "text").collect())
    assert raw == [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in sorted(got, key=lambda r: r.row_number)]
    for r in got:
        p = loop_place(r.row_number, n, seed)
        assert (r.shard, r.slot) == (p % shards, p // shards) and r.law == "rows" and r.grown_shard is None
    sizes = [sum(r.shard == k for r in got) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(m)) for k, m in enumerate(sizes))


def test_query(spark, sf, docs):
    check(docs, sharding.query(spark, sf), 40, 20_250)


def test_odd_rows(spark, odd, empty):
    check(odd, shuffled_shards(odd, 4, 3), 4, 3)
    check(odd, shuffled_shards(odd, 100, 3), 100, 3)
    assert shuffled_shards(empty, 4).count() == 0


def test_partitions_do_not_matter(spark, docs):
    a, b = shuffled_shards(docs, 8, 5), shuffled_shards(docs.repartition(13, "text"), 8, 5)
    assert sorted(rows(a)) == sorted(rows(b)) and sorted(rows(a)) != sorted(rows(shuffled_shards(docs, 8, 6)))


def test_one_id_for_all(spark):
    df = spark.range(5000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'same' AS text")
    check(df, shuffled_shards(df, 3, 1), 3, 1)


def test_files(spark, docs, tmp_path):
    write_shards(docs, str(tmp_path / "out"), 6, 2)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    where = {(r.doc_id): (r.shard, r.slot) for r in shuffled_shards(docs, 6, 2).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back} == where
    assert sorted((r.doc_id, r.text, r.lang) for r in back) == sorted((r.doc_id, r.text, r.lang) for r in docs.collect())
    one = spark.read.parquet(*sorted(map(str, (tmp_path / "out" / "shard=3").glob("*.parquet")))[:1]).collect()
    assert [r.slot for r in one] == sorted(r.slot for r in one)
    with pytest.raises(ValueError, match="slot"):
        write_shards(docs.withColumnRenamed("lang", "slot"), str(tmp_path / "no"), 2)
