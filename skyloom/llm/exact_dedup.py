"""Exact deduplication over an extendible-hash index kept on shared files (DataFrame operations only).

1. Every document gets a 64-bit hash key of its normalised text; the keys go to a shared file.
2. The directory starts with one entry for one bucket. While a bucket holds more distinct keys than
   ``bucket_capacity`` the directory doubles: each entry becomes two, one bit of the hash longer, and the two
   entries of an overfull bucket part, while those of any other go on sharing it. Nothing bounds its depth.
3. Texts are grouped on (key, text), so they are compared byte by byte; copies meet already before the shuffle,
   so a group of copies never gathers in one task. What is left of a group is short: its key, its digest
   and its size. It goes through the directory to its bucket; tasks own ranges of buckets and number the
   texts of a key, its chain. The entries go to a shared file.
4. Each document probes the index: key to directory entry, entry to bucket, bucket and key to the chain, along
   which the digest tells its own text.

The directory carries no broadcast hint: Spark broadcasts it while its file is small, and joins it with the short
rows, never with texts, beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen, stored

BLANKS = " \t\n\x0b\x0c\r"


def _first_bits(column: str, width: int, n: int):
    """The first n of the width bits of a column."""
    return F.shiftrightunsigned(column, width - n) if n else F.lit(0).cast("long")


def build_directory(keys: DataFrame, bucket_capacity: int) -> tuple[DataFrame, int]:
    """The directory of keys(h) and its depth: entry (that many first bits of a hash), bucket (its first
    local_depth bits) and local_depth."""
    distinct = keys.select("h").distinct()
    counted = lambda bits: stored(distinct.groupBy(_first_bits("h", 64, bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
    bits, cells = 16, counted(16)
    entries = lambda rows: keys.sparkSession.createDataFrame(rows, "entry long, bucket long, local_depth int")
    if (cells.agg(F.sum("n")).first()[0] or 0) <= bucket_capacity:
        return entries([(0, 0, 0)]), 0
    directory, depth = entries([(0, 0, 1), (1, 1, 1)]), 1  # the one bucket there was has parted
    while depth < 64:
        if depth > bits:
            bits = min(64, bits + 8)
            cells = counted(bits)
        loads = in_bucket(cells.select("cell", "n"), directory, depth, "cell", bits).groupBy("bucket", "local_depth").agg(F.sum("n").alias("load"))
        overfull = loads.filter(F.col("load") > bucket_capacity).select("bucket", "local_depth", F.lit(1).alias("more"))
        two = directory.join(overfull, ["bucket", "local_depth"], "left").select(
            F.explode(F.array(2 * F.col("entry"), 2 * F.col("entry") + 1)).alias("entry"), (F.col("local_depth") + F.coalesce("more", F.lit(0))).alias("local_depth")
        )
        doubled = stored(two.select("entry", F.expr(f"shiftrightunsigned(entry, {depth + 1} - local_depth)").alias("bucket"), "local_depth"), "directory")
        if doubled.agg(F.max("local_depth")).first()[0] <= depth:
            break  # no bucket was overfull: the directory before is the one
        directory, depth = doubled, depth + 1
    return directory, depth


def in_bucket(rows: DataFrame, directory: DataFrame, depth: int, key: str = "h", width: int = 64) -> DataFrame:
    """rows with the bucket and local_depth that the directory sends their key, of width bits, to."""
    if not depth:  # one entry for all: nothing to look up
        return rows.withColumns({"bucket": F.lit(0).cast("long"), "local_depth": F.lit(0)})
    return rows.withColumn("entry", _first_bits(key, width, depth)).join(directory, "entry").drop("entry")


def insert(groups: DataFrame, stays: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """groups(h, sha, group_size), one row for each text, and stays(h, sha, stays) -> the index."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = in_bucket(groups, directory, depth).repartitionByRange(parts, "bucket", "local_depth", "h")
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "local_depth", "h").orderBy("sha")) - 1)
    return stored(chained.join(stays, ["h", "sha"]).select("bucket", "local_depth", "h", "chain", "sha", "group_size", "stays"), "index")


def probe(keys: DataFrame, index: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """keys(h, sha, ...) with what the index holds of their texts, each looked for in its own bucket only."""
    return in_bucket(keys, directory, depth).join(index, ["bucket", "local_depth", "h", "sha"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 1 << 12, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty, so
    empty and blank texts form one group. The longest original text stays, then the smallest doc_id; a null
    doc_id comes last. Of repeated rows (same doc_id, same text length) that stay, one is marked kept, the first
    read. An empty table gives an empty result. key_bits under 64 shortens the hash, for tests of chained
    collisions.
    """
    rows = chosen(docs, id_col, text_col).select("doc_id", F.length("text").cast("long").alias("n"), F.translate("text", BLANKS, "").alias("norm"))
    h = F.xxhash64("norm")
    h = (h if key_bits == 64 else h.bitwiseAND(F.lit(-1 << (64 - key_bits)))).alias("h")
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    keys = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", h, sha), "keys")

    directory, depth = build_directory(keys, bucket_capacity)
    groups = rows.groupBy(h, "norm").agg(F.count(F.lit(1)).alias("group_size")).select("h", sha, "group_size")
    order = F.struct((-F.col("n")).alias("m"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    stays = keys.groupBy("h", "sha").agg(F.min(order).alias("stays"))
    index = insert(groups, stays, directory, depth)

    return probe(keys, index, directory, depth).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.concat(F.col("local_depth").cast("string"), F.lit(":"), F.col("bucket").cast("string")).alias("bucket"),
        "chain",
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER same = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


def query(spark, sf_dir):
    from .common import documents

    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
