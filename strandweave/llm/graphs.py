"""Connected components by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: So many edges at most are settled in one task, in arrays of a few megabytes; more are contracted first.
FEW = 200_000


def _settle(batches):
    """node, label (its component's smallest node) of all edges at once."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node on an edge (a, b); a label names one component.

    While there are many edges, every node joins its neighbour of the smallest hash, or stays if its own is smaller; edges
    are then drawn between what they joined. A star ends in one round, a chain shrinks by a share of its length. A node's
    neighbours are reduced to their smallest before they are shuffled. The rest, of bounded size, is settled at once.
    """
    edges = common.stored(edges.filter("a <> b").select("a", "b"), "edges")
    labels = None
    turn = 0
    while (n := edges.count()) > FEW:
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("hash"), F.col(c).alias("node"))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        to = best.select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["node"].alias("label"))
        to = common.stored(to, "joined")
        labels = to if labels is None else _moved(labels, to)
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        edges = common.stored(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if n:
        to = common.stored(edges.coalesce(1).mapInArrow(_settle, "node long, label long"), "joined")
        labels = to if labels is None else _moved(labels, to)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _moved(labels: DataFrame, to: DataFrame) -> DataFrame:
    moved = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
    return common.stored(moved.select("node", F.coalesce("next", "label").alias("label")), "labels")
