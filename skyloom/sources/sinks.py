"""Writers."""

from __future__ import annotations

import csv as csv_text
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_file_name
from ..operators.positions import numbered
from .fits import FitsSource


def csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.csv(path, header=True, mode=mode)


def _in_order(lines: DataFrame, path: str, before: str | None = None, after: str | None = None) -> None:
    """Text files that are one text in the order of their names, with a line before and behind all others. A union keeps the order of its
    parts, and files are named by partition."""
    one = lambda text: lines.sparkSession.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    out = lines if before is None else one(before).union(lines)
    (out if after is None else out.union(one(after))).write.mode("overwrite").text(path)


def csv_chunk(df: DataFrame, path: str) -> int:
    """Adds rows behind those in a folder and gives the chunk's number: all files in the order of their paths are one CSV file, with one
    header. A chunk that was broken off has no success mark and is written over. One writer at a time; columns are those of the
    first chunk. NaN and null are both empty."""
    spark = df.sparkSession
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunk-*/_SUCCESS")
    n = len(marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or [])
    header = io.StringIO()
    csv_text.writer(header, lineterminator="").writerow(df.columns)
    # a single null would be an empty line, which readers pass over
    plain = df.select(*(F.col(f"`{c}`") for c in df.columns)) if len(df.columns) > 1 else df.select(F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit("")).alias(df.columns[0]))
    line = F.to_csv(F.struct(*(_plain(c, t) for c, t in plain.dtypes)), {"escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    _in_order(plain.select(line.alias("value")), f"{path}/chunk-{n:08d}", header.getvalue() if n == 0 else None)
    return n


def json_document(df: DataFrame, path: str, key: str) -> None:
    """One JSON document in the order of its files' names: an object with each row's other columns under its key, in the order of the keys. Keys are
    different and not null; NaN and infinities become null."""
    body = F.to_json(F.struct(*_finite(df.drop(key))), {"ignoreNullFields": "false"})
    placed = numbered(df.select(F.col(key).cast("string").alias("_key"), body.alias("_body")), ["_key"], name="_place")
    name = F.substring(F.to_json(F.struct(F.col("_key").alias("k"))), 6, 1 << 30)  # {"k":"..."}
    line = F.concat(F.when(F.col("_place") > 0, ",").otherwise(""), F.regexp_replace(name, r"\}$", ""), F.lit(":"), F.col("_body"))
    _in_order(placed.orderBy("_place").select(line.alias("value")), path, "{", "}")


def object_summary(rows: DataFrame, info: DataFrame, kind: str = "kind", name: str = "object", p: str = "p_member", high: float = 0.8) -> DataFrame:
    """A row for each object of info(kind, name, n_members, algorithm, status), the one with most matched rows first: Object, Type, N_members,
    N_matched, Match_pct (null without members), N_high_prob (P over `high`), Algorithm, Status. Objects without rows have zeros."""
    counts = rows.groupBy(kind, name).agg(F.count(F.lit(1)).alias("N_matched"), F.count(F.when((F.col(p) > high) & ~F.isnan(p), 1)).alias("N_high_prob"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.round(100 * F.coalesce("N_matched", F.lit(0)) / F.nullif("n_members", F.lit(0)), 1)
    out = info.join(counts, [kind, name], "left").select(F.col(name).alias("Object"), F.col(kind).alias("Type"), F.col("n_members").alias("N_members"), zero("N_matched"), share.alias("Match_pct"), zero("N_high_prob"), F.col("algorithm").alias("Algorithm"), F.col("status").alias("Status"))
    return out.orderBy(F.desc("N_matched"), "Type", "Object")


def object_results(rows: DataFrame, info: DataFrame, path: str, kind: str = "kind", name: str = "object", p: str = "p_member", high: float = 0.8) -> None:
    """Three outputs of a run over objects: `full`, all rows in one CSV with kind and name first; `summary`, object_summary as CSV; `algorithms`, a
    JSON document with what info says of each object, its counts apart, under kind_name."""
    csv_chunk(rows.select(kind, name, *(c for c in rows.columns if c not in (kind, name))), f"{path}/full")
    csv_chunk(object_summary(rows, info, kind, name, p, high), f"{path}/summary")
    about = info.select(*(c for c in info.columns if c not in (kind, name, "n_members")), F.concat_ws("_", kind, name).alias("_of"))
    json_document(about, f"{path}/algorithms", "_of")


def _there(df: DataFrame, path: str) -> bool:
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(folder)


def _fits(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(FitsSource)
    df.write.format("fits").mode("append").save(path)


def chunks(df: DataFrame, path: str, n: int, key: str, fits: bool = False) -> None:
    """n files by hash of the key, Parquet or FITS; a folder that is there already is left as it is."""
    if not fits:
        df.repartition(n, key).write.mode("ignore").parquet(path)
    elif not _there(df, path):
        _fits(df.repartition(n, key), path)


def with_new_columns(df: DataFrame, path: str, fits: bool = False, **new: Column) -> None:
    """All columns in their order and new ones behind, Parquet or FITS; refuses to overwrite."""
    out = df.select("*", *(c.alias(n) for n, c in new.items()))
    if not fits:
        out.write.mode("errorifexists").parquet(path)
    elif _there(df, path):
        raise FileExistsError(f"{path} already exists")
    else:
        _fits(out, path)


def per_object(df: DataFrame, path: str, kind: str, name: str, keep: tuple[str, ...] = (), drop_suffix: str = "_master", json: bool = False) -> None:
    """A folder of CSV or JSON for each object, its name made safe; columns that end in drop_suffix go unless kept. JSON
    has null for NaN and infinities."""
    columns = [c for c in df.columns if not c.endswith(drop_suffix) or c in keep]
    out = df.select(*columns).withColumn(name, safe_file_name(F.col(name)))
    out = (out.select(*_finite(out)) if json else out).write.partitionBy(kind, name).mode("overwrite")
    out.option("ignoreNullFields", False).json(path) if json else out.option("header", True).csv(path)


def _plain(name: str, kind: str) -> Column:
    return F.when(~F.isnan(name), F.col(name)).alias(name) if kind in ("double", "float") else F.col(f"`{name}`")


def _finite(df: DataFrame) -> list[Column]:
    return [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row; NaN and infinities become null."""
    return df.select(F.to_json(F.struct(*_finite(df)), {"ignoreNullFields": "false"}).alias("json"))


def summary(parts: dict[str, DataFrame], label: str, order: str) -> DataFrame:
    """Tables of several runs in one, each labelled, largest first."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(F.desc(order))
