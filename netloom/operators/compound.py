"""The compound graph: both networks, and weighted edges across between candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel, ratio

COLUMNS = ["graph1", "src", "graph2", "dst", "edge_type", "weight", "distance"]


def within(edges: DataFrame, graph: str, override_weight: str | None = None) -> DataFrame:
    """Edges of one network with weight 1, or with an attribute as weight where it is present."""
    weight = F.coalesce(F.col(override_weight).cast("double"), F.lit(1.0)) if override_weight else F.lit(1.0)
    g = F.lit(graph)
    return edges.select(g.alias("graph1"), "src", g.alias("graph2"), "dst", F.concat(F.lit("within_"), g).alias("edge_type"), weight.alias("weight"), F.lit(None).cast("double").alias("distance"))


def across(pairs: DataFrame, weight) -> DataFrame:
    distance = F.col("distance") if "distance" in pairs.columns else F.lit(None).cast("double")
    return pairs.select(F.lit("G1").alias("graph1"), F.col("g1_id").alias("src"), F.lit("G2").alias("graph2"), F.col("g2_id").alias("dst"), F.lit("cross_graph").alias("edge_type"), weight.alias("weight"), distance.alias("distance"))


def gaussian(edges1: DataFrame, edges2: DataFrame, candidates: DataFrame, sigma: float = 5.0, threshold: float = 0.0, mode: str = "gaussian") -> DataFrame:
    """Cross edges weigh exp(-d^2 / 2 sigma^2); those below threshold are left out."""
    cross = across(candidates, kernel(F.col("distance"), sigma, mode)).where(F.col("weight") >= threshold)
    return within(edges1, "G1").unionByName(within(edges2, "G2")).unionByName(cross)


def structural(edges1: DataFrame, edges2: DataFrame, similarities: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Cross edges weigh the structural similarity; those below threshold are left out."""
    cross = across(similarities, F.col("similarity")).where(F.col("weight") >= threshold)
    return within(edges1, "G1").unionByName(within(edges2, "G2")).unionByName(cross)


def adjacency(compound: DataFrame) -> DataFrame:
    """(node, nbr, edge_type, weight, p, cdf): both directions of every edge, neighbours in the order of their names, p by weight.

    Where all weights of a node are zero p is null, and a walk takes the first neighbour.
    """
    a, b = F.concat_ws("_", "graph1", "src"), F.concat_ws("_", "graph2", "dst")
    there = compound.select(a.alias("node"), b.alias("nbr"), "edge_type", "weight")
    back = compound.where(a != b).select(b.alias("node"), a.alias("nbr"), "edge_type", "weight")
    w = Window.partitionBy("node")
    run = w.orderBy("nbr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.col("weight") / F.nullif(F.sum("weight").over(w), F.lit(0.0))
    return there.unionByName(back).withColumn("p", p).withColumn("cdf", F.sum("p").over(run))


def statistics(compound: DataFrame, nodes1: DataFrame, nodes2: DataFrame) -> DataFrame:
    """Counts of nodes and of edges by kind, and weight, distance and degree figures."""
    half = lambda c: F.percentile(c, F.lit(0.5))
    kinds = compound.agg(*[F.count_if(F.col("edge_type") == k).alias(f"n_{k.lower()}") for k in ("within_G1", "within_G2", "cross_graph")])
    cross = compound.where("edge_type = 'cross_graph'").agg(F.avg("weight").alias("weight_mean"), half("weight").alias("weight_median"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"), F.avg("distance").alias("distance_mean"), half("distance").alias("distance_median"))
    names = nodes1.select(F.concat(F.lit("G1_"), "id").alias("node")).unionByName(nodes2.select(F.concat(F.lit("G2_"), "id").alias("node")))
    deg = compound.select(F.explode(F.array(F.concat_ws("_", "graph1", "src"), F.concat_ws("_", "graph2", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    deg = names.join(deg, "node", "left").select(F.coalesce("d", F.lit(0)).alias("d")).agg(F.count("*").alias("n_nodes"), F.avg("d").alias("degree_mean"), half("d").alias("degree_median"), F.max("d").alias("degree_max"))
    out = kinds.crossJoin(cross).crossJoin(deg)  # one row each
    return out.withColumn("cross_share", ratio(F.col("n_cross_graph"), F.col("n_within_g1") + F.col("n_within_g2") + F.col("n_cross_graph")))
