"""Connected components of a graph that only tables hold, and of one within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of a set of edges, which tell whether a round changed it."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for nodes with an edge.

    ``edges`` has ``a`` and ``b`` of one ordered type without nulls. Each round hangs a
    node and its neighbours below the smallest among them, first the larger ones, then
    the smaller ones, until only stars are left; the number of rounds grows with the
    logarithm of the nodes. Neighbours are only ever reduced to their minimum or looked
    up, never gathered. Every round's edges are written to the shared folder.
    """
    distinct = edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = scratch.stage(distinct.distinct(), "edges")
    before = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours go to the smallest of the node and its neighbours.
        lowest = scratch.stage(
            both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "lowest"
        )
        moved = both.filter("b > a").join(lowest, "a")
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = scratch.stage(moved.filter("a != b").distinct(), "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        lowest = scratch.stage(large.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        own = lowest.select("a", F.col("low").alias("b"))
        others = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = own.unionByName(others).filter("a != b").distinct()
        now = scratch.stage(small, "small-star")
        state = _state(now)
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of ``n`` nodes with edges ``a``, ``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
