"""Intermediate tables in the folder that the cluster's executors share."""

from __future__ import annotations

import functools
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@functools.cache
def _own_dir(application: str) -> str:
    """A folder for a session on this machine alone, as tests have."""
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own and a cluster an error:
    its executors could not see such a folder."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, path: str) -> list[tuple]:
    """Path, size and time of every file under a path, on any file system that Spark reads."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def cached(spark: SparkSession, name: str, inputs: list[str], parameters: dict, build: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The stored result of build() for these inputs and parameters, read if it is there and written first if not. Its name is a digest of the
    inputs' files (path, size, time) and the parameters (as JSON), so a change of either builds it anew. Only a whole result counts:
    a write that was broken off has no success mark, and is written over. folder: where results stay, else the shared folder."""
    key = json.dumps([[_state(spark, p) for p in inputs], parameters], sort_keys=True)
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/{name}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more: what came of them must be stored by now."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
