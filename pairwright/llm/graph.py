"""Connected components of an edge table, without any driver-side state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm import textscan as ts
from pairwright.llm.scratch import Scratch

#: Edges that a task contracts at a time.
BLOCK = 1 << 18


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every other node of these edges alone."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[a], root[b]
        if (u == v).all():
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        x, y = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(z) for z in stars(x, y)], ["x", "y"])

    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) >= BLOCK:
            yield done()
            held = []
    if held:
        yield done()


def merged(comp: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str, parts: int | None = None) -> DataFrame:
    """`components` of the edges (x, y) and of all that `comp` (node, component) came from.

    The new edges are taken between the components that they meet, so that what was settled before is not
    gone through again, and tasks contract theirs to stars first, so that few rounds are left.
    No end of an edge is null.  `parts`: as for `components`.
    """
    edges = edges.select("x", "y")
    if comp is not None:
        for end in ("x", "y"):
            old = comp.select(F.col("node").alias("was"), F.col("component").alias("now"))
            edges = edges.join(old, edges[end] == old["was"], "left").withColumn(end, F.coalesce("now", end)).select("x", "y")
    edges = edges.filter("x <> y").mapInArrow(ts.tidied(_contracted), "x long, y long")
    new = components(edges, scratch, f"{name}-new" if comp is not None else name, parts)
    if comp is None:
        return new
    # Only components whose label fell meet anything: one that many nodes have has mostly settled.
    moved = new.filter("component <> node").select(F.col("node").alias("was"), F.col("component").alias("now"))
    rows = comp.join(moved, comp["component"] == moved["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    rows = rows.unionByName(new.join(comp.select("node"), "node", "left_anti"))
    return scratch.table(_few(rows, parts), name)


def _few(df: DataFrame, parts: int | None) -> DataFrame:
    return df.coalesce(parts) if parts else df


def components(edges: DataFrame, scratch: Scratch, name: str, parts: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `edges` (x, y).

    Each round lowers a node's label to the least label among its neighbours and then to
    the label of that label, so rounds follow the logarithm of a component's diameter,
    not the diameter.  Minima combine map-side; a node of very many edges costs one row per task.
    Rows with a null end are no edges; a node that has only edges to itself is its own component without a row; an empty
    table gives an empty result.  `parts`: tables are written by so many tasks at most, for edges that are known to be few.
    """
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct()
    both = scratch.table(_few(both, parts), f"{name}-edges")
    labels = scratch.table(_few(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")), parts), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["x"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        # Components whose own label fell, one row each.  One that many nodes have has mostly settled, and then meets nothing in the join with all labels.
        own = lower.select(F.col("node").alias("un"), F.col("component").alias("root")).filter("root < un")
        moved = lower.select(F.col("component").alias("c")).distinct().join(own, F.col("c") == F.col("un")).select("c", "root")
        new = lower.join(moved, lower["component"] == moved["c"], "left").select("node", "old", F.coalesce("root", "component").alias("component"))
        k += 1
        new = scratch.table(_few(new, parts), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels
