"""Characterisation of networks and of pairs of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance, ratio
from ..store import Store
from .components import components
from .spatial import colocated, located, mutual_nearest, node_spacing


def graph_statistics(nodes: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """Nodes, edges, components, size of the largest, and nodes with coordinates."""
    parts = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), store, "statistics")
    named = nodes.select("id").join(parts, F.col("id") == F.col("node"), "left").select(F.coalesce("component", "id").alias("c"))
    sizes = named.groupBy("c").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    counts = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("located"))
    return counts.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(sizes)  # one row each


def network_statistics(nodes: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """Sizes, median spacing in metres, extent in kilometres."""
    spacing = node_spacing(nodes, store).agg(F.percentile("spacing", F.lit(0.5)).alias("s_m"))
    box = located(nodes).agg(F.count("*").alias("nodes"), ((F.max("x") - F.min("x")) / 1000).alias("extent_x_km"), ((F.max("y") - F.min("y")) / 1000).alias("extent_y_km"))
    return box.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(spacing)


def pair_statistics(nodes1: DataFrame, nodes2: DataFrame, spacing: float, tolerance: float, cutoff: float) -> DataFrame:
    """Size ratio, co-located share in percent, mutual nearest pairs within cutoff and their displacement and shift."""
    n = nodes1.agg(F.count("*").alias("n1")).crossJoin(nodes2.agg(F.count("*").alias("n2")))
    same = colocated(nodes1, nodes2, tolerance).agg(F.count("*").alias("same"))
    pairs = mutual_nearest(nodes1, nodes2, cutoff)
    a = nodes1.select(F.col("id").alias("g1_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes2.select(F.col("id").alias("g2_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = distance("x1", "y1", "x2", "y2")
    moved = pairs.select("g1_id", "g2_id").join(a, "g1_id").join(b, "g2_id").agg(F.count("*").alias("mutual_pairs"), F.avg(d).alias("mean_displacement_m"), F.percentile(d, F.lit(0.5)).alias("median_displacement_m"), F.avg(F.col("x2") - F.col("x1")).alias("dx"), F.avg(F.col("y2") - F.col("y1")).alias("dy"))
    out = n.crossJoin(same).crossJoin(moved)
    return out.select(ratio(F.col("n2"), F.col("n1")).alias("ratio"), (100 * ratio(F.col("same"), F.col("n1"))).alias("colocated_pct"), "mutual_pairs", "mean_displacement_m", "median_displacement_m", (F.col("mean_displacement_m") / spacing).alias("displacement_over_s"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("shift_m"), F.lit(float(cutoff)).alias("cutoff_m"))


def zone_diagnostics(nodes: DataFrame, edges: DataFrame, kept: DataFrame, kept_edges: DataFrame, severed: DataFrame, store: Store) -> DataFrame:
    """kept(id, role): core and halo sizes, how many nodes of each changed degree when the rest was cut off, severed edges."""
    from .graph import degrees

    full, now = degrees(nodes, edges), degrees(kept, kept_edges)
    both = kept.select("id", "role").join(full.withColumnRenamed("degree", "full"), "id").join(now, "id")
    changed = lambda r: F.count_if((F.col("role") == r) & (F.col("full") != F.col("degree")))
    out = both.agg(F.count_if(F.col("role") == "core").alias("core"), F.count_if(F.col("role") == "halo").alias("halo"), changed("core").alias("core_changed"), changed("halo").alias("halo_changed"))
    return out.crossJoin(severed.agg(F.count("*").alias("severed")))
