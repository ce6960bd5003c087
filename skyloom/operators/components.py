"""Connected components of an edge table, by alternating large and small stars.

The edges are pairs (v, r), r < v: v points to r. A large star leads every larger neighbour of a node to the
least node about it, a small star leads a node and its smaller neighbours to the least of them (Kiveris et
al., 2014). Both keep what is connected connected and end in stars about the least nodes, in a number of
rounds that grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def local_stars(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: each node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([v, r]), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]


def _contracted(whole: bool):
    """Edges of a batch, or of a whole partition, as stars."""

    def run(batches):
        for pdf in [pd.concat(list(batches) or [pd.DataFrame({"v": [], "r": []}, dtype=np.int64)])] if whole else batches:
            v, r = local_stars(pdf.v.to_numpy(), pdf.r.to_numpy())
            yield pd.DataFrame({"v": v, "r": r})

    return run


def connected_components(edges: DataFrame, finish_edges: int = 1 << 20) -> DataFrame:
    """edges(a, b) -> (node, label), label the smallest node reachable; loops and repeats do no harm, edges of
    null nodes are left out, an empty table gives an empty result.

    Each batch of edges becomes stars before it is dealt out, which only lessens the rounds. Minima are
    aggregated, so that a node with any number of neighbours is combined before the shuffle, and written before
    they are joined back, so that Spark can split the join at such a node. Every step is written to the shared
    folder and deleted once its successor is. At most finish_edges edges (16 bytes each) are finished by one task, which changes
    nothing but speed."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    stars = lambda df, whole=False: df.mapInPandas(_contracted(whole), "v long, r long")
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("r")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    now = stored(stars(now).distinct(), "edges")
    while True:
        if now.count() <= finish_edges:
            own = stored(stars(now.repartition(1), True), "own")
            discard(now)
            break
        around = now.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.col("r").alias("least")) for c in ("v", "r")))))
        least = stored(around.groupBy("node").agg(F.min("least").alias("least")), "least")
        # the least about a node, that larger ones point to
        large = stored(now.join(least.withColumnRenamed("node", "r"), "r").select("v", F.col("least").alias("r"), (F.col("least") != F.col("r")).alias("moved")).distinct(), "large")
        own = stored(large.groupBy("v").agg(F.min("r").alias("r")), "own")
        moved = large.agg(F.max("moved").alias("any"), F.count(F.lit(1)).alias("n")).first()
        if not moved.any and moved.n == own.count():
            discard(now, least, large)
            break
        others = large.select("v", F.col("r").alias("other")).join(own, "v").filter("other <> r").select("other", "r")
        after = stored(stars(own.union(others)).distinct(), "edges")
        discard(now, least, large, own)
        now = after
    return own.union(own.select("r", "r").distinct()).toDF("node", "label")


def groups(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Every node with its group (itself where it has no edge)."""
    labels = connected_components(edges).select(F.col("node").alias(node), "label")
    return nodes.join(labels, node, "left").withColumn("group_id", F.coalesce("label", node)).drop("label")
