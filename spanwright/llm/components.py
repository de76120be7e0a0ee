"""Connected components of a graph that no single machine holds.

Each partition first joins its own edges (a forest of them replaces any number of edges), then
large-star and small-star steps alternate until every node points at the smallest node of its component.  A node with very
many neighbours is met only in aggregates that combine before the shuffle and in joins that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import discard, written


class Forest:
    """Union-find over integers; the root of a tree is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (above := parent.get(top, top)) != top:
            top = above
        while (above := parent.get(x, x)) != top:
            parent[x] = top
            x = above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def contract(edges: DataFrame) -> DataFrame:
    """Replace the (u, v) edges of each partition by stars with the same components."""

    def run(batches):
        forest = Forest()
        for frame in batches:
            for a, b in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                forest.join(a, b)
        nodes = np.fromiter(forest.parent, np.int64, len(forest.parent))
        roots = np.fromiter((forest.root(x) for x in forest.parent), np.int64, len(nodes))
        yield pd.DataFrame({"u": nodes[nodes != roots], "v": roots[nodes != roots]})

    return edges.select("u", "v").mapInPandas(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges with u > v; every node hands its neighbours to the smallest of them and itself."""
    around = edges.union(edges.select("v", "u")) if large else edges
    around = around.toDF("x", "y")
    least = around.groupBy("x").agg(F.min("y").alias("m"))
    least = least.select("x", F.least("x", "m").alias("m"))
    moved = around.join(least, "x")
    if large:
        moved = moved.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("y").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("x").alias("u"), F.col("m").alias("v"))
        )
    return moved.where("u != v").distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the (u, v) edges; component is the smallest node reachable."""
    now = contract(edges)
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        last, now = now, written(_star(_star(now, large=True), large=False), "edges")
        discard(last)
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
