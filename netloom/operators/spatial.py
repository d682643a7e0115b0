"""Joins in the plane: within a radius, nearest, mutually nearest, co-located. All are equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..store import Store


def located(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def radius_join(g1: DataFrame, g2: DataFrame, radius: float) -> DataFrame:
    """(g1_id, g2_id, distance) of all pairs at most radius apart. Cells are as wide as the radius, so a node meets nine cells at most."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    a = located(g1).select(F.col("id").alias("g1_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = located(g2).select(F.col("id").alias("g2_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("o"))
    b = b.select("g2_id", "x2", "y2", (cell("x2") + F.col("o.i")).alias("cx"), (cell("y2") + F.col("o.j")).alias("cy"))
    d = distance("x1", "y1", "x2", "y2")
    # nine rows a node escape the estimate of b's size, so it is never broadcast
    return a.join(b.hint("merge"), ["cx", "cy"]).where(d <= radius).select("g1_id", "g2_id", d.alias("distance"))


def nearest_join(g1: DataFrame, g2: DataFrame, bound: float) -> DataFrame:
    """For each g1 node its nearest g2 node strictly nearer than bound; ties go to the smaller id."""
    near = radius_join(g1, g2, bound).where(F.col("distance") < bound)
    best = near.groupBy("g1_id").agg(F.min(F.struct("distance", "g2_id")).alias("m"))
    return best.select("g1_id", "m.g2_id", "m.distance")


def mutual_nearest(g1: DataFrame, g2: DataFrame, bound: float) -> DataFrame:
    there = nearest_join(g1, g2, bound)
    back = nearest_join(g2, g1, bound).select(F.col("g1_id").alias("g2_id"), F.col("g2_id").alias("g1_id"))
    return there.join(back, ["g1_id", "g2_id"])


def colocated(g1: DataFrame, g2: DataFrame, tolerance: float, both_sides: bool = False) -> DataFrame:
    """g1 nodes with exactly one g2 node within tolerance; with both_sides that partner must be no one else's among these."""
    one = radius_join(g1, g2, tolerance).groupBy("g1_id").agg(F.count("*").alias("m"), F.first("g2_id").alias("g2_id"), F.first("distance").alias("distance")).where("m = 1").drop("m")
    if both_sides:
        sole = one.groupBy("g2_id").count().where("count = 1").select("g2_id")
        one = one.join(sole, "g2_id", "left_semi")
    return one.select("g1_id", "g2_id", "distance")


def node_spacing(nodes: DataFrame, store: Store, start: float = 16.0) -> DataFrame:
    """(id, spacing): distance to the nearest other node. Nodes with nothing near look further, the radius doubled each round."""
    nodes = store.cut(located(nodes).select("id", "x", "y"), "nodes")
    box = nodes.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count("*").alias("n")).first()
    found, left, radius, k = [], nodes, start, 0
    while (box["n"] or 0) > 1:
        near = radius_join(left, nodes, radius).where("g1_id <> g2_id").groupBy(F.col("g1_id").alias("id")).agg(F.min("distance").alias("spacing"))
        near = store.cut(near, f"near-{k}")
        found.append(near)
        left = store.cut(left.join(near, "id", "left_anti"), f"left-{k}")
        if radius > 2 * (box["w"] + box["h"]) + start or not left.limit(1).count():
            break
        radius, k = 2 * radius, k + 1
    out = nodes.select("id", F.lit(None).cast("double").alias("spacing")).limit(0)
    for f in found:
        out = out.unionByName(f)
    return out


def coverage_radius(displacement: DataFrame, base: float = 20.0, coverage: float = 0.99) -> DataFrame:
    """Displacement statistics and the candidate radius that covers the given share: max(base, 5 * ceil(q / 5))."""
    q = F.percentile("displacement", F.lit(coverage))
    stats = displacement.agg(F.avg("displacement").alias("mean"), F.percentile("displacement", F.lit(0.5)).alias("median"), q.alias("q"), F.max("displacement").alias("max"))
    return stats.withColumn("radius", F.greatest(F.lit(float(base)), 5.0 * F.ceil(F.col("q") / 5.0)))


def coverage(displacement: DataFrame, radius: float) -> DataFrame:
    """The share of displacements within the radius; those that are null are left out."""
    return displacement.where("displacement is not null").agg((F.count_if(F.col("displacement") <= radius) / F.count("*")).alias("coverage"))
