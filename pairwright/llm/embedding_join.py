"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated at random and cut into blocks of a few dimensions.  Two vectors
with cosine c are at squared distance 2 - 2c; if that is within the limit, then in one
block at least their squared distance is within the block's share, proportional
to its dimensions.  So each block is range-joined by itself, on a grid as wide as the
block's radius, and what any block finds is verified exactly, on the vectors as given, in
double precision.  A pair that several blocks find belongs to the first of them, so
nothing has to be deduplicated, and a task returns sums of links and a spanning forest
instead of pairs.

Equal vectors are one node with a weight from the start.  A cell of more than `tile`
members is cut into tiles of at most two such chunks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm import textscan as ts
from pairwright.llm.graph import components
from pairwright.llm.scratch import Scratch

#: Dimensions of a block, rows of a distance matrix, allowance for rounding of squared distances.
#: Sixteen keep candidates rare: of random pairs in 64 dimensions, about 2 in a million are within a block's share, against 800 with eight.
BLOCK, STRIP, SLACK = 16, 1024, 1e-6


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_917 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int) -> list[slice]:
    edges = np.linspace(0, d, max(1, d // BLOCK) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(u: np.ndarray) -> np.ndarray:
    """Rounded to a grid of 2**-30, so that the shape of a matrix product doesn't show."""
    return np.round(u @ rotation(u.shape[1]) * 2.0**30) / 2.0**30


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in a batch."""
    col = batch.column(column)
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    length = np.diff(off)
    for d in np.unique(length).tolist():
        rows = np.flatnonzero(length == d)
        yield rows, flat[(off[rows][:, None] + np.arange(d))]


def _cells(limit: float, depth: int):
    names = ["cell", "block", "home", "id", "weight", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 2000):
                batch = big.slice(start, 2000)
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], batch.schema.names)
                for rows, m in _matrices(batch, "vector"):
                    d = m.shape[1]
                    rot = rotated(unit(m))
                    for b, part in enumerate(blocks(d)):
                        width = np.sqrt(limit * (part.stop - part.start) / d) * (1 + SLACK) + SLACK
                        k = min(depth, part.stop - part.start)
                        at = np.floor(rot[:, part][:, :k] / width).astype(np.int64)
                        for step in itertools.product((-1, 0, 1), repeat=k):
                            if step < (0,) * k:
                                continue
                            cell = np.full(len(rows), d * 4096 + b, np.int64)
                            for c in range(k):
                                cell = cell * 512 + (at[:, c] + step[c] + 256)
                            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(rows), b, np.int32)), pa.array(np.full(len(rows), not any(step))), *(batch.column(c).take(pa.array(rows)) for c in ("id", "weight", "vector"))], names)

    return run


class _Forest:
    """Least reachable index, for links that come in portions."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            if (x == y).all():
                return
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def tile_links(block: int, chunk: np.ndarray, home: np.ndarray, weight: np.ndarray, m: np.ndarray, limit: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of links, forest label) of each member of a tile, from the pairs that belong to `block`."""
    u = unit(m)
    rot = rotated(u)
    n, d = rot.shape
    parts = blocks(d)
    share = [limit * (p.stop - p.start) / d + SLACK for p in parts]
    part = parts[block]
    # In order of a second coordinate, strips too far apart need no look.
    by = rot[:, part][:, -1]
    order = np.lexsort((by, chunk))
    own = rot[order][:, part].astype(np.float32)
    norm, one = (own * own).sum(1, keepdims=True), np.ones((n, 1), np.float32)
    left, right = np.hstack([-2 * own, one, norm]), np.ascontiguousarray(np.hstack([own, norm, one]).T)  # their product is the squared distance
    links, forest = np.zeros(n), _Forest(n)
    two = len(np.unique(chunk)) > 1
    for i in range(0, n, STRIP):
        a = order[i : i + STRIP]
        for j in range(i, n, STRIP):
            b = order[j : j + STRIP]
            if two and (chunk[a] == chunk[b[0]]).all() and (chunk[b] == chunk[a[0]]).all():
                continue
            if not (home[a].any() or home[b].any()):
                continue
            if not two and by[b[0]] - by[a[-1]] > np.sqrt(share[block]) + SLACK:
                break
            near = left[i : i + STRIP] @ right[:, j : j + STRIP] <= share[block] + 1e-4
            x, y = np.divmod(np.flatnonzero(near), len(b))
            once = x < y if j == i else np.ones(len(x), bool)
            x, y = a[x], b[y]
            ok = once & (home[x] | home[y])
            if two:
                ok &= chunk[x] != chunk[y]
            x, y = x[ok], y[ok]
            for s in range(0, len(x), 200_000):
                p, q = x[s : s + 200_000], y[s : s + 200_000]
                # This block must be the first whose share the pair keeps within, and this must be the pair's cell.
                sure = np.ones(len(p), bool)
                for k in range(block + 1):
                    diff = rot[p][:, parts[k]] - rot[q][:, parts[k]]
                    within = (diff * diff).sum(1) <= share[k]
                    sure &= within if k == block else ~within
                p, q = p[sure], q[sure]
                cos = (u[p] * u[q]).sum(1)
                p, q = p[cos >= cosine], q[cos >= cosine]
                if len(p):
                    links += np.bincount(p, weight[q], n) + np.bincount(q, weight[p], n)
                    forest.add(p, q)
    return links, forest.label


def _search(limit: float, cosine: float):
    """Rows sorted by (cell, low, high): (id, links, other) with the weight of links found, and a smaller member that is reached."""
    names = ["id", "links", "other"]

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = t.combine_chunks().to_batches()[0]
        ids, block = batch.column("id").to_numpy(), int(batch.column("block")[0].as_py())
        ((_, m),) = _matrices(batch, "vector")
        order = np.argsort(ids, kind="stable")  # so that the least index is the least id
        links, label = tile_links(block, batch.column("chunk").to_numpy()[order], batch.column("home").to_numpy(zero_copy_only=False)[order], batch.column("weight").to_numpy()[order].astype(float), m[order], limit, cosine)
        ids = ids[order]
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[label[hit]])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "low", "high")], 1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edge = np.r_[0, edge, len(batch)]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                now = tuple(keys[a])
                if held and now != last:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def linkable(e: Column) -> Column:
    """Neither null, empty nor zero, without null or non-finite components."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, tile: int = 32_768, depth: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors` (vec_id, embedding).

    Links are pairs with a cosine of at least `cosine`, equal vectors included; vectors of
    different lengths have none, nor have null, empty or zero vectors or those with null
    or non-finite components, nor rows without vec_id.  Rows that repeat an id are vectors of
    their own.  `depth` is the number of grid dimensions in a block,
    `tile` how many members of a cell meet in a task; neither changes the result.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-join")
    limit = 2.0 - 2.0 * cosine
    kind = vectors.schema["embedding"].dataType.elementType
    clean = F.transform("embedding", lambda x: x + F.lit(0).cast(kind))  # no negative zero
    label = [F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), F.size("v").alias("d")]
    rows = vectors.select("vec_id", F.when(linkable(F.col("embedding")) & F.col("vec_id").isNotNull(), clean).alias("v"))
    nodes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    nodes = scratch.table(nodes.select("id", "weight", F.col("v").alias("vector"), *label), "nodes")
    if not nodes.groupBy("id").count().filter("count > 1").isEmpty():  # an id with several vectors: nodes go by a hash of both
        nodes = scratch.table(nodes.withColumn("vec_id", F.col("id")).withColumn("id", F.xxhash64("vec_id", "vector")), "renamed")
    else:
        nodes = nodes.withColumn("vec_id", F.col("id"))
    cells = nodes.select("id", "weight", "vector").mapInArrow(ts.tidied(_cells(limit, depth)), f"cell long, block int, home boolean, id long, weight long, vector array<{kind.simpleString()}>")
    sizes = scratch.table(cells.groupBy("cell").count().select("cell", F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("g")).filter("g > 1"), "sizes")
    split = cells.join(sizes, "cell", "left") if not sizes.isEmpty() else cells.withColumn("g", F.lit(None).cast("int"))
    g = F.coalesce("g", F.lit(1))
    split = split.withColumn("chunk", F.pmod(F.xxhash64("id"), g).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), g - 1)))
    split = split.withColumn("low", F.least("chunk", "with")).withColumn("high", F.greatest("chunk", "with"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = split.select("cell", "low", "high", "block", "home", "chunk", "id", "weight", "vector").repartition(4 * n, "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    found = scratch.table(dealt.mapInArrow(ts.tidied(_search(limit, cosine)), "id long, links long, other long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("x"), F.col("other").alias("y")), scratch, "links")
    comp = nodes.select("id", "vec_id", "weight", "h1", "h2", "d").join(links, "id", "left").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    comp = scratch.table(comp.select("h1", "h2", "d", "vec_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c")), "linked")
    least = comp.groupBy("c").agg(F.min("vec_id").alias("component_id"))  # smallest vec_id, whatever the nodes go by
    comp = scratch.table(comp.drop("vec_id").join(least, "c").drop("c"), "result")
    scratch.keep("result")
    named = rows.select("vec_id", *[F.when(F.col("v").isNotNull(), c).alias(x) for c, x in zip(label, ("h1", "h2", "d"))])
    out = named.join(comp, ["h1", "h2", "d"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
