"""Connected components: of an edge table by random-priority contraction, all in joins and aggregations; of a task's arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); all nodes of a component share one root, which is one of them.

    Each round every node points to that one of itself and its neighbours whose hash in this round is least, and
    edges are moved to the pointed-at nodes. The priorities are fresh in each round, so a path shrinks by a constant
    factor as a star does, whatever the order of ids. Rounds end when no edge is left; pointers are then followed
    back. A node with very many neighbours only takes part in aggregations that combine before the shuffle and in
    joins whose large side can be split.
    """
    edges = durable(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    pointers: list[DataFrame] = []
    for step in range(max_rounds):
        if edges.isEmpty():
            break

        def rank(node, step=step):
            return F.struct(F.xxhash64(F.lit(step), F.col(node)).alias("h"), F.col(node).alias("node"))

        both = edges.select("u", rank("v").alias("r")).union(edges.select(F.col("v").alias("u"), rank("u").alias("r")))
        best = both.groupBy("u").agg(F.min("r").alias("r"))
        point = durable(best.select(F.col("u").alias("node"), F.least("r", rank("u"))["node"].alias("to")))
        pointers.append(point)
        moved = edges.join(point.select(F.col("node").alias("u"), F.col("to").alias("tu")), "u").join(point.select(F.col("node").alias("v"), F.col("to").alias("tv")), "v")
        before, edges = edges, durable(moved.where(F.col("tu") != F.col("tv")).select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct())
        release(before)
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not pointers:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    release(edges)
    final = pointers[-1].select("node", F.col("to").alias("root"))
    for earlier in reversed(pointers[:-1]):
        later = final.select(F.col("node").alias("to"), F.col("root").alias("end"))
        before, final = final, durable(earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("root")))
        release(before, earlier)
    return final


def least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; ``nodes`` has those without edges too."""
    roots = components(edges)
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")


def merge_level(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node of its component under the links (u, v)."""
    root = np.arange(n)
    while len(u):
        new = root.copy()
        np.minimum.at(new, u, np.minimum(u, v))
        np.minimum.at(new, v, np.minimum(u, v))
        while (new != new[new]).any():
            new = new[new]
        root = new[root]
        u, v = new[u], new[v]
        open_ = u != v
        u, v = u[open_], v[open_]
    return root
