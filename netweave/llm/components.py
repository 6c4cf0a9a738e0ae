"""Connected components of a graph that no machine holds, by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.session import materialize


def local_roots(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``nodes`` numbers the smallest number it is linked to, directly or not."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(before, root):
            return root


def _stars(edges: DataFrame) -> DataFrame:
    """One round: link all larger neighbours, then all smaller ones, to the smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = (both.where("b > a").join(least, "a")
             .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    # Every edge now leads from a larger node to a smaller one.
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the undirected ``edges`` (``a``, ``b``): the least node it reaches.

    Loops, repeats and null ends do not matter.  Each round is written to the shared folder;
    a hub's edges meet only in partial aggregates and in joins that can be split.
    """
    whole = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(whole.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = materialize(_stars(now), "stars")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and a sum over them that tells two sets apart."""
    sums = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")) for c in (("a", "b"), ("b", "a"))]
    return tuple(edges.agg(F.count("*"), *sums).first())
