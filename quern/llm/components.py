"""Connected components of an undirected edge table: partitions of bounded size contract their own edges, then large-star and small-star rounds join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_stored, stored

#: Edges of a partition that is contracted (16 bytes each).
CONTRACTED = 1 << 20


def _toward_minimum(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Links each node's neighbours (only those above it, for the large star) to the least of the node and its neighbours.

    The least neighbour is a partial aggregate joined back, so that a node with very many neighbours is never gathered.
    """
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    met = pairs.join(least, "u")
    if larger_only:
        return met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _settled(now: DataFrame) -> bool:
    """Whether every node above the least of its component is linked to that one alone."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes, and the least node that each reaches, by hooking roots to lesser ones and shortening paths."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, before[side], low)
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the same nodes as a partition's: of each CONTRACTED edges, every node with the least that it reaches."""
    held: list[pa.RecordBatch] = []

    def emitted() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("u", "v"))
        nodes, roots = _roots(u, v)
        above = nodes > roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[above]), pa.array(roots[above])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CONTRACTED:
            yield emitted()
            held.clear()
    if held:
        yield emitted()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable. Nodes without an edge have no row.

    Every round is written to the shared folder; the number of edges never grows. Null ends and loops are ignored. Rounds go on
    until every node is linked to the least of its component alone, which large-star and small-star rounds always reach; edges that
    fill one partition only are there after its contraction.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")

    def contracted(table: DataFrame) -> tuple[DataFrame, bool]:
        parts = -(-table.count() // CONTRACTED)
        out = stored(table.coalesce(max(parts, 1)).mapInArrow(_contracted, "u bigint, v bigint"), "edges")
        drop_stored(table)
        return out, parts <= 1 or _settled(out.distinct())

    now, settled = contracted(now)
    while not settled:
        edges = now.distinct()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both, True).filter("u <> v").distinct()
        small = stored(_toward_minimum(large, False).filter("u <> v").distinct(), "edges")
        drop_stored(now)
        now, settled = contracted(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
