"""Connected components by alternating large-star and small-star steps, which one task ends once
few links are left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of these links that are not their own root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _finish(batches):
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        node, root = least_reachable(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60, together: int = 1 << 20) -> DataFrame:
    """(u, v) links between 64-bit nodes -> (node, root): root is the smallest reachable node.
    Nodes that are their own root do not occur. Every round is a written table; no node's
    neighbours are gathered, only their minimum, and hubs are broadcast. One task ends the work at
    ``together`` links (16 MB) or fewer."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, digest, step = scratch.save(pairs, "links0"), None, 0
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).head()
        if digest == tuple(seen) or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if seen[0] <= together:
            return scratch.save(now.coalesce(1).mapInArrow(_finish, "node long, root long"), "roots")
        digest, step = tuple(seen), step + 1
        if step > most_rounds:
            raise RuntimeError(f"components: no fixed point after {most_rounds} rounds")
        # Large star: each node ties its greater neighbours to its least neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        least = scratch.save(least.where("n > 0").select("u", F.least("u", "m").alias("m"), "n"), f"least{step}")
        large = meet(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large{step}")
        # Small star: each node ties its lesser neighbours and itself to the least of them.
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"low{step}")
        small = meet(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = scratch.save(small, f"links{step}")
        for name in (f"links{step - 1}", f"least{step}", f"large{step}", f"low{step}"):
            scratch.drop(name)
