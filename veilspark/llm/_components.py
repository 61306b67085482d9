"""Connected components of an edge table by alternating large-star and small-star steps, all distributed; a table of
few edges is solved whole by one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage

#: At most so many edges (16 MB) go to one task: it takes a second, where rounds of small jobs take longer.
LOCAL_EDGES = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, u, v = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    while True:
        x, y = up[u], up[v]
        if (x == y).all():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _solve(batches):
    t = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    node, label = least_reachable(t.column("a").to_numpy(), t.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Minima are staged: Spark then sees their size, broadcasts them if small, else splits the partitions of hubs.
    least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-large")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a long, b long): the label is the component's least node.

    Repeated edges and loops are fine; a node with nothing but a loop is not returned. The number of rounds is about
    the logarithm of the longest path; every round is staged. Up to LOCAL_EDGES different edges need no rounds.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "cc-edges")
    if edges.count() <= LOCAL_EDGES:
        return edges.repartition(1).mapInArrow(_solve, "node long, label long")
    now = stage(_small_star(edges), "cc")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stage(_small_star(_large_star(now)), "cc")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
