"""A training corpus from raw documents: language, exact and near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.llm.common import stored
from skyloom.llm.decontam import decontaminate
from skyloom.llm.exact_dedup import exact_dedup
from skyloom.llm.langid import language_id
from skyloom.llm.packing import pack
from skyloom.llm.simhash import simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs):
    """docs with a key of each row, 128 bits of hash of its id and text: ids may be null or repeated."""
    of = [F.col("doc_id").isNull(), F.col("text").isNull(), F.col("doc_id"), F.col("text")]
    return docs.select(*COLUMNS, F.concat(F.hex(F.xxhash64(*of)), F.lit("."), F.hex(F.xxhash64(F.lit(1), *of))).alias("_row"))


def _only(rows, keep):
    """Documents whose row key is in keep."""
    return rows.join(keep.select("_row").distinct(), "_row", "left_semi").select(*COLUMNS)


def _one_of_each(rows, groups, *first):
    """Of each group of row keys, the row that is least by `first`, then has the smallest id; a null id is the last."""
    order = F.struct(*first, F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    short = rows.select("_row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return _only(rows, short.join(groups.distinct(), "_row").groupBy("group").agg(F.min(order).alias("m")).select("m._row"))


def language(spark, docs, sf_dir):
    """Documents in a language that could be told: those without text or letters go."""
    rows = _keyed(docs)
    return _only(rows, language_id(rows, id_col="_row").filter("lang_pred <> 'und'").select(F.col("doc_id").alias("_row")))


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts, the longest; of repeated rows, one."""
    rows = _keyed(docs)
    groups = exact_dedup(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("text_sha256").alias("group"))
    return _one_of_each(rows, groups, (-F.col("n")).alias("size")).dropDuplicates(["doc_id", "text"])


def near(spark, docs, sf_dir):
    """One document of each component of near copies, that with the smallest doc_id."""
    rows = _keyed(docs)
    return _one_of_each(rows, simhash_dedup(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")))


def decontaminated(spark, docs, sf_dir):
    """Documents of which under a twentieth of the words is in benchmark windows."""
    rows = _keyed(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return _only(rows, found.filter("NOT contaminated").select(F.col("doc_id").alias("_row")))


def packed(spark, docs, sf_dir):
    """Pieces of all documents in windows of 4096 tokens at the sources' shares."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("packed", packed)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
