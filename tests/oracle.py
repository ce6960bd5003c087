"""Rows of a query against those of its SQL, in any order; floats to a relative 1e-6."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _key(row):
    return tuple((v is None, f"{v:.4g}" if isinstance(v, float) else str(v)) for v in row)


def _close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b or str(a) == str(b)


def differences(df, sql, c):
    """None if both give the same rows, else what differs."""
    got = df.toPandas()
    want = c.sql(sql)
    names = sorted(want.columns)
    if sorted(got.columns) != names:
        return f"columns {sorted(got.columns)} and {names}"
    a = [tuple(_plain(v) for v in r) for r in got[names].astype(object).itertuples(index=False)]
    b = [tuple(_plain(v) for v in r) for r in c.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()]
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    ints = [(i, n) for i, n in enumerate(names) if "int" in str(got[n].dtype)]
    order = [i for i, n in enumerate(names) if not any(isinstance(r[i], float) for r in a[:50])]
    key = lambda r: (_key(tuple(r[i] for i in order)), _key(r))
    bad = [(x, y) for x, y in zip(sorted(a, key=key), sorted(b, key=key)) if not all(map(_close, x, y))]
    return f"{len(bad)} of {len(a)} rows, first {bad[0]} in {names} (integers {ints})" if bad else None
