"""Carving a zone out of a network: the nodes of a box as core, some hops around it as halo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Store
from .components import components
from .graph import halo, induced
from .stats import zone_diagnostics


def box(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Nodes with x0 <= x < x1 and y0 <= y < y1."""
    return nodes.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def component_count(nodes: DataFrame, edges: DataFrame, store: Store, name: str) -> int:
    """Connected components, nodes without edges among them."""
    linked = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), store, name)
    row = linked.agg(F.countDistinct("component"), F.count("*")).first()
    return row[0] + nodes.select("id").distinct().count() - row[1]


def carve(nodes: DataFrame, edges: DataFrame, bounds: tuple[float, float, float, float], depth: int, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with role, edges, diagnostics): the box as core, nodes within depth hops as halo, edges with both ends inside.

    Diagnostics: sizes, nodes of each role whose degree changed, severed edges, and the components of the zone and of the core alone.
    """
    core = box(nodes, *bounds)
    role = F.when(F.col("depth") == 0, "core").otherwise("halo").alias("role")
    kept = store.cut(halo(edges, core, depth, store).select("id", role), "zone-roles")
    _, inside, severed = induced(nodes, edges, kept)
    inside = store.cut(inside, "zone-edges")
    within = nodes.drop("role").join(kept, "id") if "role" in nodes.columns else nodes.join(kept, "id")
    cores = kept.where("role = 'core'").select("id")
    core_edges = induced(kept, inside, cores)[1]
    counted = {"components": component_count(kept, inside, store, "zone"), "core_components": component_count(cores, core_edges, store, "core")}
    found = zone_diagnostics(nodes, edges, kept, inside, severed, store)
    return within, inside, found.withColumns({k: F.lit(v).cast("long") for k, v in counted.items()})
