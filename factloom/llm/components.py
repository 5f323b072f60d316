"""Connected components of an edge table: small tables in one task, others by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialize

#: Edges that one task takes (32 MB); the result does not depend on it.
ONE_TASK = 1 << 21


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node that each can reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        # hook the roots of both ends to the lesser one, then shorten every path
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches]
    if parts:
        nodes, roots = least_reachable(*(np.concatenate(p) for p in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Nodes of the edges ``(a, b)`` with the smallest node that each can reach: ``(node, root)``.

    Each round hooks every node's larger neighbours, then its smaller ones, to the smallest neighbour
    (large star, small star); rounds grow with the logarithm of the nodes.  Stars of any size work: the
    minimum is pre-aggregated before the shuffle and no neighbourhood is collected.  Every round is
    written to the shared folder, so a lost executor costs one round at most.  Self loops, repeated
    edges and either direction are accepted; nodes without an edge do not appear.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now = materialize(now, "edges")
    if now.count() <= one_task:
        return now.repartition(1).mapInArrow(_one_task, "node long, root long")
    before = None
    while True:
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u")
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "true")
        last, now = now, materialize(small, "stars")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _star(directed: DataFrame, which: str) -> DataFrame:
    """Connect each node's neighbours that satisfy ``which`` (and for small stars the node) to the least of all."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = directed.join(least, "u")
    if which == "true":
        pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    else:
        pairs = joined.filter(which).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.filter("u != v").distinct()
