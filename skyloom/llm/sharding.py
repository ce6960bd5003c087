"""Reproducible shuffling into shards: a Feistel permutation of global row numbers.

Rows are numbered in the order of their id (then of their text's hash), whatever files or partitions they come from.
The permutation of these numbers is keyed by a seed: rounds of a Feistel network on the next even number of bits, walked
on until the number is in range again. A row's place after the shuffle is computed from its number alone, and its
number from its place, so any task can find any row without a table of places: place p is slot p // shards of
shard p % shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import numbered
from .common import chosen, documents, stored

_ALL = (1 << 64) - 1


def _mixed(x):
    """A 64-bit finaliser: every bit of x on every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A permutation of 0 .. n - 1 for n up to 2^62, and its inverse."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 6):
        if not 0 <= n <= 1 << 62:
            raise ValueError("from 0 to 2^62 numbers")
        self.n, self.half = n, max(1, -(-max(0, n - 1).bit_length() // 2))
        steps = np.array([(seed + (i + 1) * 0x9E3779B97F4A7C15) & _ALL for i in range(rounds)], np.uint64)
        self.keys = _mixed(steps)

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        return right << bits | left  # halves change places, so that the keys in reverse undo it

    def _walked(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers out of range go through again: those in range are permuted among themselves."""
        out = x.astype(np.uint64)
        at = np.arange(len(out))
        while len(at):
            out[at] = self._network(out[at], keys)
            at = at[out[at] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def place(self, number: np.ndarray) -> np.ndarray:
        return self._walked(np.asarray(number), self.keys)

    def number(self, place: np.ndarray) -> np.ndarray:
        return self._walked(np.asarray(place), self.keys[::-1])


def locate(number: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers among n."""
    place = Feistel(n, seed).place(number)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Number of the row at slots of shards: the inverse of locate."""
    return Feistel(n, seed).number(np.asarray(slot) * shards + np.asarray(shard))


def _located(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """rows(row_number, ...) with shard and slot."""
    n = rows.count()

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).place(number.to_numpy()))

    at = rows.withColumn("_place", place("row_number"))
    return at.withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": F.expr(f"_place div {shards}")}).drop("_place")


def shuffled_shards(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, row_number, law, shard, slot, grown_shard.

    The law is `rows`: shards' row counts differ by at most one, and slots count up from 0 in each. Another number of shards
    deals all rows anew, so grown_shard is null. Only ids and texts decide, not files or partitions; rows equal in both
    are alike, and take their numbers in any order. A null text counts as empty, null ids come first. A text
    is read once and leaves the scan as a row of a few numbers. An empty table gives an empty result."""
    rows = chosen(docs, id_col, text_col)
    raw = F.encode("text", "utf-8")
    thin = stored(rows.select("doc_id", (F.octet_length("text") + F.lit(16)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("_hash")), "rows")
    out = _located(stored(numbered(thin, ["doc_id", "text_crc32", "_hash"], name="row_number"), "numbered"), shards, seed)
    return out.select("doc_id", "size", "text_crc32", "row_number", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs with all their columns as Parquet, a folder shard=k for each shard, rows of a file in the order of their slots, which
    is a column. Columns named row_number, shard or slot are an error. A shard larger than a task's share is several files,
    whose slots follow one another."""
    if clash := {"row_number", "shard", "slot", "_crc", "_hash"} & set(docs.columns):
        raise ValueError(f"columns named {sorted(clash)}")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({"_crc": F.crc32(F.encode(text, "utf-8")), "_hash": F.xxhash64(text)})
    at = _located(stored(numbered(keyed, [F.col(f"`{id_col}`"), "_crc", "_hash"], name="row_number"), "numbered"), shards, seed).drop("_crc", "_hash")
    at.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir):
    return shuffled_shards(documents(spark, sf_dir), 40, seed=20_250)
