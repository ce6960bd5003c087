"""The tables at hand seen as a catalogue: customers are stars, orders are detections of them, line items are
measurements. The same formulas stand in the SQL beside each frame, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR = """c_custkey AS id, (c_custkey * 137.50776405e0) % 360e0 AS ra, degrees(asin(1.98e0 * ((c_custkey * 0.6180339887e0) % 1e0) - 0.99e0)) AS dec,
  (c_custkey % 41 - 20) / 2e0 AS pmra, (c_custkey % 29 - 14) / 2e0 AS pmdec, 0.2e0 + (c_custkey % 97) / 10e0 AS plx, 0.05e0 + (c_custkey % 7) / 50e0 AS e_plx,
  c_name AS name, c_mktsegment AS kind, c_acctbal AS mag"""
SEEN = """o_orderkey AS id, o_custkey AS star, s.ra + ((o_orderkey % 13) - 6) * 0.02e0 AS ra, s.dec + ((o_orderkey % 11) - 5) * 0.02e0 AS dec,
  s.pmra + ((o_orderkey % 7) - 3) / 50e0 AS pmra, s.pmdec + ((o_orderkey % 5) - 2) / 50e0 AS pmdec,
  CASE WHEN o_orderkey % 10 <> 3 THEN s.plx + ((o_orderkey % 9) - 4) / 20e0 END AS plx, CASE WHEN o_orderkey % 10 <> 4 THEN 0.05e0 + (o_orderkey % 5) / 20e0 END AS e_plx,
  o_orderpriority AS survey, (o_totalprice % 400e0) - 200e0 AS rv, 0.5e0 + (o_orderkey % 17) / 4e0 AS err, o_orderdate AS seen_at"""
MEASURE = """l_partkey AS star, l_orderkey * 10 + l_linenumber AS row_id, concat(l_returnflag, l_linestatus) AS survey,
  CASE WHEN l_discount <> 0.05 THEN l_extendedprice / 100e0 END AS rv, CASE WHEN l_tax <> 0.02 THEN l_quantity END AS err, l_quantity AS snr, l_discount AS disc, l_tax AS tax, l_suppkey AS field"""

SQL_STAR = f"star AS (SELECT {STAR} FROM customer)"
SQL_SEEN = f"{SQL_STAR}, seen AS (SELECT {SEEN} FROM orders JOIN star s ON s.id = o_custkey)"
SQL_MEASURE = f"m AS (SELECT {MEASURE} FROM lineitem)"


def _split(text: str) -> list[str]:
    """Expressions of a select list, cut at commas outside brackets."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stars(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").selectExpr(*_split(STAR))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").join(stars(spark, sf).alias("s"), F.col("s.id") == F.col("o_custkey")).selectExpr(*_split(SEEN))


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").selectExpr(*_split(MEASURE))


def prefixed(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"r_{c}" for c in df.columns))
