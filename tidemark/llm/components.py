"""Connected components of a distributed edge list by alternating stars.

Both steps use a minimum with map-side combining and a join, which the adaptive
planner splits when one node has very many edges; nothing is collected. Every round
is cut off by a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Edges that one task turns into a forest.
TASK_EDGES = 200_000


def spanning(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least node of each node's component, from edges between a and b."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def local_forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (long columns a and b) with the same components: TASK_EDGES at a time
    are replaced by a spanning forest of theirs."""
    edges = checkpointed(edges)
    parts = max(1, -(-edges.count() // TASK_EDGES))

    def run(batches):
        ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not ends:
            return
        a, b = (np.concatenate(c) for c in zip(*ends))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = spanning(len(nodes), at[: len(a)], at[len(a) :])
        node = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[node]), pa.array(nodes[root[node]])], ["a", "b"])

    return checkpointed(edges.repartition(parts).mapInArrow(run, "a long, b long"))


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge but the roots; root is the least node reachable.

    ``edges``: columns a and b of one orderable type, never null; loops and repeats are allowed."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = checkpointed(edges)
    marks = _marks(edges)
    while marks[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = checkpointed(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = _marks(edges)
        if now == marks:
            break
        marks = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
