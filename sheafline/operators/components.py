"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Edges that one task may join by union-find; beyond that labels spread by joins.
LOCAL_EDGES = 1_000_000


def connected_components(edges: DataFrame, a: str, b: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for every node that has an edge; bigint nodes.

    ``component`` is the smallest node of the component. Rows with a null end
    are ignored; self-loops give a component of one node; an empty table gives
    no rows. Small edge lists (counted) are solved in one task, others by
    minimum labels with pointer jumping, in rounds.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")
    )
    pairs = cut(pairs.distinct())
    if pairs.count() <= local_edges:
        return pairs.coalesce(1).mapInPandas(_union_find, "node long, component long")
    both = cut(pairs.select("u", "v").union(pairs.select("v", "u")))
    label = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        seen = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("__m"))
        stepped = cut(
            label.join(seen, F.col("node") == F.col("u")).select("node", F.least("component", "__m").alias("component"), F.col("component").alias("__old"))
        )
        up = stepped.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        label2 = cut(stepped.join(up, F.col("component") == F.col("__n")).select("node", F.least("component", "__c").alias("component"), "__old"))
        changed = not label2.where("component <> __old").isEmpty()
        label = label2.select("node", "component")
        if not changed:
            return label


def _union_find(batches):
    frames = list(batches)
    if not frames:
        return
    u = np.concatenate([f["u"].to_numpy() for f in frames])
    v = np.concatenate([f["v"].to_numpy() for f in frames])
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = flat[: len(u)], flat[len(u) :]
    yield pd.DataFrame({"node": nodes, "component": nodes[united(len(nodes), left, right)]})


def united(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the smallest one of its component of the given pairs."""
    label = np.arange(n)
    while True:  # hook the larger label on the smaller one, then halve the paths
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            far = label[label]
            if np.array_equal(far, label):
                break
            label = far
        if np.array_equal(before, label):
            return label
