"""Connected components of an undirected edge list, by alternating stars.

Each round first points every node's larger neighbours, then its smaller ones,
at the node's smallest neighbour.  Minima are grouped aggregates with map-side
combining, and go back by joins that Spark may split when skewed, so a node
with very many edges doesn't land in one task.  Rounds grow with the logarithm
of the longest path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: 16 MB of edges.
SMALL_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b) with a > b -> the same components, closer to stars."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _union(batches):
    """Union-find over the edges of one task: (node, root)."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    nodes, at = np.unique(pairs, return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in at.reshape(-1, 2).tolist():
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for i, r in enumerate(root):  # parents come before their children
        root[i] = root[r]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_EDGES) -> DataFrame:
    """(node, root): every node with an edge, and the smallest node it reaches. Up to ``small`` edges, counted first, are joined in one task of bounded memory."""
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "edges")
    if now.count() <= small:
        out = written(now.coalesce(1).mapInArrow(_union, "node long, root long"), "roots")
        drop(now)
        return out
    state = None
    while True:
        before, now = now, written(_star(_star(now, True), False), "stars")
        drop(before)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state or not new[0]:
            break
        state = new
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    out = written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")
    drop(now)
    return out
