"""Structural similarity of nodes from the degrees found at each distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of one side in a block of the all-pairs comparison.
BLOCK = 2048


def rectification(nodes1: DataFrame, edges1: DataFrame, nodes2: DataFrame, edges2: DataFrame) -> tuple[float, float]:
    """Factors for the degrees of the first and of the second graph: sqrt of the ratio of the mean degrees, and its reciprocal."""
    v1, e1, v2, e2 = (df.count() for df in (nodes1, edges1, nodes2, edges2))
    if not (v1 and e1 and v2 and e2):
        return 1.0, 1.0
    factor = ((e2 / v2) / (e1 / v1)) ** 0.5
    return factor, 1 / factor


def ring_bounds(rings: DataFrame, factor: float = 1.0) -> DataFrame:
    """(id, k, lo, hi): log(least degree + 1) and log(largest + 1) of each ring, degrees scaled by factor."""
    low, high = F.array_min("degrees") * F.lit(factor), F.array_max("degrees") * F.lit(factor)
    return rings.select(F.col("root").alias("id"), F.col("depth").alias("k"), F.log(low + 1.0).alias("lo"), F.log(high + 1.0).alias("hi"))


def features(bounds: DataFrame, depth: int) -> DataFrame:
    """bounds with a row for every k from 0 to depth; an empty ring takes the values of the ring before it."""
    grid = bounds.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k"))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = grid.join(bounds, ["id", "k"], "left")
    return filled.select("id", "k", F.last("lo", True).over(w).alias("lo"), F.last("hi", True).over(w).alias("hi"))


def pair_distance(pairs: DataFrame, bounds1: DataFrame, bounds2: DataFrame) -> DataFrame:
    """pairs(g1_id, g2_id) with structural distance: the sum over rings that both nodes have of |difference of lo| + |difference of hi|."""
    a = bounds1.select(F.col("id").alias("g1_id"), "k", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = bounds2.select(F.col("id").alias("g2_id"), F.col("k").alias("k2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    joined = pairs.select("g1_id", "g2_id").join(a, "g1_id").join(b, (pairs["g2_id"] == b["g2_id"]) & (F.col("k") == F.col("k2"))).drop(b["g2_id"])
    return joined.groupBy("g1_id", "g2_id").agg(F.sum(F.abs(F.col("lo1") - F.col("lo2")) + F.abs(F.col("hi1") - F.col("hi2"))).alias("structural_distance"))


def similarity(distances: DataFrame, alpha: float = 1.0) -> DataFrame:
    return distances.withColumn("similarity", F.exp(-F.lit(float(alpha)) * F.col("structural_distance")))


def vectors(filled: DataFrame) -> DataFrame:
    """(id, f): the feature rows of each node as one array."""
    parts = F.array_sort(F.collect_list(F.struct("k", "lo", "hi")))
    return filled.groupBy("id").agg(F.flatten(F.transform(parts, lambda p: F.array(p["lo"], p["hi"]))).alias("f"))


def top_pairs(f1: DataFrame, f2: DataFrame, alpha: float, m: int, block: int = BLOCK) -> DataFrame:
    """(g1_id, g2_id, similarity) of the m structurally closest g2 nodes of each g1 node, ties to the smaller id.

    Nodes of equal features have the same closest ones, and of g2 nodes of equal features only the m smallest ids can be among them: one node of each
    kind of g1 is compared with those. Both sides are dealt into blocks; a task compares one pair of blocks and keeps its best m, so no pair of nodes
    is ever a row before that.
    """
    kinds = f1.groupBy("f").agg(F.min("id").alias("kind"))
    offered = f2.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("id"))).where(F.col("r") <= m).drop("r")
    found = _top_pairs(kinds.select(F.col("kind").alias("id"), "f"), offered, alpha, m, block).withColumnRenamed("g1_id", "kind")
    return f1.join(kinds, "f").select(F.col("id").alias("g1_id"), "kind").join(found, "kind").select("g1_id", "g2_id", "similarity")


def _top_pairs(f1: DataFrame, f2: DataFrame, alpha: float, m: int, block: int) -> DataFrame:
    """top_pairs of every row of either side."""

    def deal(f: DataFrame, other: int, mine: str, theirs: str, side: int) -> DataFrame:
        count = max(1, -(-f.count() // block))
        return f.select(F.lit(side).alias("side"), "id", "f", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(mine)), count

    a, n1 = deal(f1, 0, "b1", "b2", 1)
    b, n2 = deal(f2, 0, "b2", "b1", 2)
    a = a.withColumn("b2", F.explode(F.sequence(F.lit(0), F.lit(n2 - 1)))).select("side", "id", "f", "b1", "b2")
    b = b.withColumn("b1", F.explode(F.sequence(F.lit(0), F.lit(n1 - 1)))).select("side", "id", "f", "b1", "b2")

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids = table["id"].to_numpy()
        x = np.asarray(table["f"].combine_chunks().flatten()).reshape(len(ids), -1)
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        two = two[np.argsort(ids[two])]
        out = ([], [], [])
        if len(two):
            for i in one.tolist():
                d = np.round(np.abs(x[two] - x[i]).sum(1), 12)
                best = np.argsort(d, kind="stable")[:m]
                out[0].append(np.full(len(best), ids[i]))
                out[1].append(ids[two[best]])
                out[2].append(np.exp(-alpha * d[best]))
        parts = [np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, float), strict=True)]
        return pa.table(dict(zip(("g1_id", "g2_id", "similarity"), parts, strict=True)))

    near = a.unionByName(b).groupBy("b1", "b2").applyInArrow(compare, "g1_id long, g2_id long, similarity double")
    w = Window.partitionBy("g1_id").orderBy(F.desc("similarity"), "g2_id")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= m).drop("r")


def top_pairs_both(f1: DataFrame, f2: DataFrame, alpha: float, m: int, block: int = BLOCK) -> DataFrame:
    """(g1_id, g2_id, similarity): the m closest g2 nodes of each g1 node and the m closest g1 nodes of each g2 node, each pair once."""
    there = top_pairs(f1, f2, alpha, m, block)
    back = top_pairs(f2, f1, alpha, m, block).select(F.col("g2_id").alias("g1_id"), F.col("g1_id").alias("g2_id"), "similarity")
    return there.unionByName(back).groupBy("g1_id", "g2_id").agg(F.max("similarity").alias("similarity"))
