"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) that join what the edges (a, b) join: fewer than nodes."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:  # nodes are sorted, so the smallest index is the smallest node
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges(a, b).

    Both stars move neighbours towards the smallest node in sight, so the rounds grow with the
    logarithm of the longest path. The smallest neighbours are partial aggregates, written down
    before they are joined back: a join of two plain shuffles is one that Spark splits at a node
    with very many links. Each round is written to the shared folder, and the one before deleted.
    Nulls and loops join nothing; an empty table gives no rows.
    """
    now = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    seen, old = None, []
    for _ in range(most_rounds):
        at = [scratch.path(name) for name in ("least", "large", "down", "stars")]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", at[0])
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large", at[1])
        down = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "down", at[2])
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.keep(small, "stars", at[3])
        for path in (*old, *at[:3]):
            scratch.drop(path)
        old = at[3:]
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        seen = mark
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
