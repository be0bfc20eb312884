"""Connected components over an edge table: few edges in one task, many by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import drop, save

#: Edges that one task may join.
FEW = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. The minimum of a node's neighbours is aggregated first and joined back, so that a node with very many
    neighbours is never gathered in one task."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    if large:
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = both.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def forest(n: int, pairs) -> np.ndarray:
    """The least node that each of n nodes is joined to by the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while not np.array_equal(root, up := root[root]):
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return root


def _together(batches):
    edges = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
    if edges:
        nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = forest(len(nodes), [(a, b)])
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 40, few: int = FEW) -> DataFrame:
    """edges: (a long, b long). Returns (a, b): each linked node a with the least node b of its component, b <> a.

    Up to ``few`` edges, a bound of some 16 MB, go through one task. Of more, each round is written to the shared folder,
    which ends its lineage; it ends when the edges form stars.
    """
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.count() <= few:
        return save(now.coalesce(1).mapInArrow(_together, "a long, b long"))
    for _ in range(max_rounds):
        heads = now.select(F.col("b").alias("a")).distinct()
        chained = now.join(heads, "a", "left_semi").limit(1).count()
        forked = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not chained and not forked:
            return now
        now, before = save(_star(_star(now, large=True), large=False)), now
        drop(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
