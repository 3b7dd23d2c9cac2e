"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Edges that a task contracts together, about.
HELD_EDGES = 1 << 18


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the given ones, but the smallest of each component, to the smallest of its component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):  # every root with a smaller neighbour goes below one, so at most half of a component's roots are left
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v)`` that connect what the given ones do, no more than these: of HELD_EDGES at a time the components, as stars."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(table.column(0).to_numpy(), table.column(1).to_numpy())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Both steps keep connectivity and together need a number of rounds that
    grows with the logarithm of the longest path.  Each takes the smallest
    neighbour by an aggregate that Spark combines before the shuffle, so a node
    with very many edges never gathers them in one place.  Before the first
    round tasks contract the edges that they hold anyway, so that what has few
    edges takes one round, and with it few plans on the driver.  Both sides of a join
    are shuffled, so they are merged at any size: to broadcast one after that
    would only cost the driver a thread and a table that it holds.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().mapInArrow(_contract, "u long, v long"), "edges")
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, old = materialize(small, "edges"), edges
        discard(old)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(edges)
    return out
