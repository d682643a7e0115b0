"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Store

#: Contracted edges (16 bytes each) that one task may hold; with more, star rounds run on all executors.
ONE_TASK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of these edges, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    root = np.empty(len(nodes), np.int64)
    for i in range(len(nodes)):  # parents come first
        root[i] = i if up[i] == i else root[up[i]]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of what the task holds; folded as it comes, so that memory follows the nodes, not the edges."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, store: Store, name: str, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """edges(a long, b long) to (node, component): the smallest node that each can reach; nodes without an edge are left out.

    Each task first replaces its edges by a spanning forest. If few edges remain, one task joins them; else large-star and small-star
    rounds run until nothing changes, each round's table being written so that lineage stays short.
    """
    now = store.cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "a long, b long"), f"{name}-0")
    if now.limit(one_task + 1).count() <= one_task:
        out = store.cut(now.coalesce(1).mapInArrow(_contract, "a long, b long"), f"{name}-c")
        store.free(f"{name}-0")
    else:
        k, out = 0, None
        while out is None:
            # large star: every larger neighbour, and the node itself, is tied to the smallest of the neighbourhood
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            # small star: every smaller neighbour, and the node itself, is tied to the smallest of them
            down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = down.groupBy("a").agg(F.min("b").alias("m"))
            small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            k += 1
            after = store.cut(small, f"{name}-{k}")
            same = after.count() == now.count() and after.exceptAll(now).limit(1).count() == 0
            store.free(f"{name}-{k - 1}")
            now = after
            if same:
                out = now
    roots = out.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return out.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
