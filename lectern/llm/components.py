"""Connected components of a graph given as a table of edges: contraction within tasks, then large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written
from .tokens import lean

#: Edges (16 bytes each) that one task contracts.
EDGES_A_TASK = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the least that is reachable by edges (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above


def _forest(batches):
    """The edges of a task as stars: an edge from each node to the least of its component within the task."""
    a, b = [], []
    for x in batches:
        a.append(x.column("a").to_numpy())
        b.append(x.column("b").to_numpy())
    if a:
        node, at = np.unique(np.concatenate(a + b), return_inverse=True)
        half = len(at) // 2
        label = least_reachable(at[:half], at[half:], len(node))
        below = label < np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(node[label[below]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of all nodes of edges (a, b), both long and not null.

    Each task contracts its own edges to stars, so there are as many tasks as the edges need.  With more than one task,
    stars of a node meet in large-star and small-star steps: sums by node and joins, so a node with any number of
    neighbours is no group in one task (the sums are written, and Spark can split a join's hot key).  The steps grow with
    the logarithm of the longest path; each one's edges are written, which cuts lineage.
    """
    now, before = written(edges.where("a != b").select("a", "b"), "edges"), None
    while True:
        tasks = -(-now.count() // EDGES_A_TASK)
        stars = written(now.coalesce(max(1, tasks)).mapInArrow(lean(_forest), "a long, b long"), "stars")
        removed(now)
        if tasks <= 1:
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            stars = now
            break
        before = state
    own = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own)
