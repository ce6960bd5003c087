"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored  # noqa: F401  the operators take it from here


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chosen(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Only what an operator reads, under its own names: clashing extra columns never meet it."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *(F.col(f"`{c}`").alias(name) for name, c in more.items()),
    )


def mapped(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows.mapInPandas(run, schema) with integer ids as text on the way: pandas holds integers beside nulls as doubles, which round
    large ids."""
    kind = dict(rows.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return rows.mapInPandas(run, schema)
    columns = [F.col("doc_id").cast("string").alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in rows.columns]
    out = rows.select(*columns).mapInPandas(run, schema.replace(f"doc_id {kind}", "doc_id string", 1))
    return out.select(*(F.col(c).cast(kind).alias(c) if c == "doc_id" else c for c in out.columns))
