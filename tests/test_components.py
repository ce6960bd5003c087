"""Components on long paths, hubs and odd edges, and the folder that intermediate tables go to."""

import os
import subprocess
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom import storage
from skyloom.operators import components

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("finish", [0, 1 << 20])
def test_random_graphs_and_odd_edges(spark, finish):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (330, 2))] + [(1000, 5000 + i) for i in range(500)] + [(7, 7), (1, 2), (2, 1)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(5)
    got = {r.node: r.label for r in components.connected_components(df, finish).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.connected_components(df.limit(0), finish).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    write = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: rounds.append(name) or write(df, name))
    ids = np.random.default_rng(0).permutation(100_000)
    df = spark.createDataFrame(pd.DataFrame({"a": ids[:-1], "b": ids[1:]}))
    out = components.connected_components(df, finish_edges=0).agg(F.max("label"), F.count("node")).first()
    assert tuple(out) == (0, 100_000) and rounds.count("least") <= 2 * 17


def test_superseded_tables_are_deleted(spark):
    df = storage.stored(spark.range(5), "gone")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file:").replace("//", "/"))
    assert os.path.isdir(folder)
    storage.discard(df)
    assert not os.path.exists(folder)


def test_a_session_without_the_setting(tmp_path):
    code = """
from pyspark.sql import SparkSession
from skyloom import storage
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
assert storage.stored(spark.range(3), 'x').count() == 3
class Cluster:
    conf, sparkContext = spark.conf, type('C', (), {'master': 'spark://host:7077', 'getConf': spark.sparkContext.getConf})
try:
    storage.shared_dir(Cluster)
except ValueError as e:
    assert storage.SETTING in str(e)
else:
    raise AssertionError('a cluster needs the setting')
print('fine')
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": HERE, "TMPDIR": tempfile.gettempdir()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-2000:]
