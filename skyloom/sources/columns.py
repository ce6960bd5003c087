"""Column names: aliases, clean-up, pairing, checks before reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite


def clean_header(df: DataFrame) -> DataFrame:
    """Names without byte-order mark and blanks around."""
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """A double column for each key, from the first of its names that the table has, any case; null without, and for NaN
    and infinities."""
    have = {c.lower(): c for c in df.columns}
    pick = {k: next((have[n.lower()] for n in [k, *names] if n.lower() in have), None) for k, names in aliases.items()}
    value = lambda c: F.lit(None).cast("double") if c is None else finite(F.col(f"`{c}`").cast("string").try_cast("double"))
    return df.withColumns({k: value(c) for k, c in pick.items()})


def paired(columns: list[str], value: str, error: str) -> list[tuple[str, str]]:
    """Columns whose name holds `value` with those that hold `error`, in order."""
    errors = [c for c in columns if error.lower() in c.lower()]
    values = [c for c in columns if value.lower() in c.lower() and c not in errors]
    return list(zip(values, errors))


def renamed(df: DataFrame, suffix: str, except_: tuple[str, ...] = ()) -> DataFrame:
    return df.toDF(*(c if c in except_ else c + suffix for c in df.columns))


def preflight(df: DataFrame, required: list[str]) -> dict:
    """Missing columns, rows, and size in memory at eight bytes a value; no data leaves the executors."""
    n = df.count()
    return {"missing": [c for c in required if c not in df.columns], "rows": n, "gb": n * 8 * len(df.columns) / 1e9}


def sentinels_out(df: DataFrame, columns: list[str], sentinel: float = -999.0) -> DataFrame:
    return df.withColumns({c: F.nullif(finite(F.col(c).cast("string").try_cast("double")), F.lit(float(sentinel))) for c in columns})
