"""Controlled degradation of a network, with provenance. Random numbers are hashes of (seed, step, id): no order, no partitioning matters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance, normal, uniform
from ..store import Store

OFFSET = 10_000_000


class Network:
    """nodes(id, x, y, role, origin) and edges(src, dst); origin is null for invented nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges


def numbered(rows: DataFrame, order: list[str], first: int, name: str = "id") -> DataFrame:
    """rows with consecutive numbers from first on in the order of columns that tell them apart; no task sorts all rows.

    Rows are dealt into ranges of the order and written; each range is then numbered by itself from the count of the rows before it.
    """
    store = Store(rows.sparkSession, "numbered")
    ranged = store.cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a range
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return local.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_rank") - 1 + F.lit(first)).cast("long")).drop("_range", "_before", "_rank")


def relabelled(net: Network, offset: int = OFFSET, order: str = "id") -> Network:
    """Fresh consecutive ids from offset on in the order of the column `order`, which must tell nodes apart."""
    return _renamed(net, numbered(net.nodes.select("id", order) if order != "id" else net.nodes.select("id"), [order], offset, "new").select("id", "new"))


def _renamed(net: Network, ids: DataFrame) -> Network:
    nodes = net.nodes.join(ids, "id").drop("id").withColumnRenamed("new", "id")
    edges = net.edges.join(ids.select(F.col("id").alias("src"), F.col("new").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst")
    return Network(nodes.select("id", *[c for c in nodes.columns if c != "id"]), edges.select(F.col("s").alias("src"), F.col("d").alias("dst")))


def identity(net: Network, offset: int = OFFSET) -> Network:
    """The same network under fresh ids from offset on; origin is the old id."""
    return relabelled(Network(net.nodes.withColumn("origin", F.col("id")), net.edges), offset)


def jitter(net: Network, sigma: float, seed: int, step: int = 0) -> Network:
    """Independent normal displacement of every node by sigma in x and y."""
    moved = lambda c: F.col(c) + sigma * normal(seed, step, c_lit(c), "id")
    return Network(net.nodes.withColumns({"x": moved("x"), "y": moved("y")}), net.edges)


def c_lit(text: str):
    return F.lit(text)


#: Control points on each side of a node's own that are summed; those further off weigh less than 1e-9 of the nearest.
REACH = 10


def warp(net: Network, amplitude: float, spacing: float, seed: int, step: int = 0) -> Network:
    """A smooth displacement field: normals at control points of a grid, averaged with Gaussian weights, scaled to amplitude in root mean square.

    The grid covers the nodes' box padded by one spacing and is stretched to it: at least two points a side, no more than one spacing apart. The
    control points around each grid cell are packed once; a node joins its cell's, so its displacement takes one row.
    """
    x0, y0, x1, y1 = net.nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if x0 is None:
        return net
    sides = {}
    for c, low, high in (("x", x0, x1), ("y", y0, y1)):
        low, high = low - spacing, high + spacing
        points = max(2, math.ceil((high - low) / spacing) + 1)
        sides[c] = (low, (high - low) / (points - 1), points)
    (lx, hx, nx), (ly, hy, ny) = sides["x"], sides["y"]
    cell = lambda c, low, h: F.floor((F.col(c) - low) / h)
    placed = net.nodes.withColumns({"_i": cell("x", lx, hx), "_j": cell("y", ly, hy)})
    around = lambda c, points: F.explode(F.sequence(F.greatest(F.col(c) - REACH, F.lit(0)), F.least(F.col(c) + REACH + 1, F.lit(points - 1))))
    near = placed.select("_i", "_j").distinct().select("_i", "_j", around("_i", nx).alias("gi")).select("_i", "_j", "gi", around("_j", ny).alias("gj"))
    drawn = lambda c: normal(seed, step, F.lit(c), "gi", "gj")
    point = F.struct((F.lit(lx) + F.col("gi") * hx).alias("x"), (F.lit(ly) + F.col("gj") * hy).alias("y"), drawn("x").alias("u"), drawn("y").alias("v"))
    controls = near.groupBy("_i", "_j").agg(F.collect_list(point).alias("_points"))
    weight = lambda p: F.exp(-((F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])) / (2.0 * spacing * spacing))
    start = F.struct(*[F.lit(0.0).alias(k) for k in "wuv"])
    total = F.aggregate(F.transform("_points", lambda p: F.struct(weight(p).alias("w"), p["u"].alias("u"), p["v"].alias("v"))), start, lambda s, p: F.struct((s["w"] + p["w"]).alias("w"), (s["u"] + p["w"] * p["u"]).alias("u"), (s["v"] + p["w"] * p["v"]).alias("v")))
    field = placed.join(controls, ["_i", "_j"]).withColumn("_sum", total)
    field = field.withColumns({"_dx": F.col("_sum.u") / F.col("_sum.w"), "_dy": F.col("_sum.v") / F.col("_sum.w")}).drop("_i", "_j", "_points", "_sum")
    field = Store(net.nodes.sparkSession, "warp").cut(field, "field")
    rms = field.agg(F.sqrt(F.avg(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))).first()[0]
    scale = float(amplitude) / rms if rms else 0.0
    return Network(field.withColumns({"x": F.col("x") + scale * F.col("_dx"), "y": F.col("y") + scale * F.col("_dy")}).drop("_dx", "_dy"), net.edges)


def least(rows: DataFrame, key, order: list[str], k: int, store: Store, buckets: int = 1 << 16) -> DataFrame:
    """The k rows of least key, a number in [0, 1), ties by order: whole buckets of keys, and of the bucket where they end the least."""
    keyed = store.cut(rows.withColumn("_key", key).withColumn("_bucket", F.floor(F.col("_key") * buckets)), "keyed")
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("n"))
    ends = counts.withColumn("end", F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # `buckets` rows at most
    edge = ends.where(F.col("end") >= k).orderBy("_bucket").select("_bucket", F.col("end") - F.col("n")).first()
    if edge is None or not k:
        return keyed.where(F.lit(bool(k))).drop("_key", "_bucket")
    whole = keyed.where(F.col("_bucket") < edge[0])
    return whole.unionByName(keyed.where(F.col("_bucket") == edge[0]).orderBy("_key", *order).limit(k - edge[1])).drop("_key", "_bucket")


def densify(net: Network, fraction: float, seed: int, step: int = 0) -> Network:
    """round(fraction * edges) edges, each once at most, are split at their middle by an invented node; it is core if both ends are.

    Invented nodes are numbered on from the largest id of the network.
    """
    store = Store(net.edges.sparkSession, "densify")
    nodes, edges = net.nodes, store.cut(net.edges.select("src", "dst"), "edges")
    k = round(fraction * edges.count())
    if not k:
        return Network(nodes.select("id", "x", "y", "role", "origin"), edges)
    split = store.cut(numbered(least(edges, uniform(seed, step, "src", "dst"), ["src", "dst"], k, store), ["src", "dst"], nodes.agg(F.max("id")).first()[0] + 1), "split")
    ends = nodes.select("id", "x", "y", "role")
    a, b = (ends.select(F.col("id").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}"), F.col("role").alias(f"role_{e}")) for e in ("src", "dst"))
    role = F.when((F.col("role_src") == "core") & (F.col("role_dst") == "core"), "core").otherwise("halo")
    added = split.join(a, "src").join(b, "dst").select("id", ((F.col("x_src") + F.col("x_dst")) / 2).alias("x"), ((F.col("y_src") + F.col("y_dst")) / 2).alias("y"), role.alias("role"), F.lit(None).cast("long").alias("origin"))
    halves = split.select("src", F.col("id").alias("dst")).unionByName(split.select(F.col("id").alias("src"), "dst"))
    kept = edges.join(split.select("src", "dst"), ["src", "dst"], "left_anti")
    return Network(nodes.select("id", "x", "y", "role", "origin").unionByName(added), kept.unionByName(halves))


FAMILIES = {"jitter": jitter, "warp": warp, "densify": densify}


def composite(net: Network, steps: list[dict], level: float, seed: int) -> Network:
    """Steps in their order, such as {"family": "jitter", "sigma": "@level"}; "@level" stands for the variant's level."""
    out = identity(net)
    for k, step in enumerate(steps):
        how = {p: (level if v == "@level" else v) for p, v in step.items() if p != "family"}
        out = FAMILIES[step["family"]](out, **how, seed=seed, step=k)
    return out


def provenance(net: Network, original: DataFrame, role: str = "role") -> DataFrame:
    """(new_id, origin, origins, role, displacement): where each node of the perturbed network came from, and how far it went."""
    before = original.select(F.col("id").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    joined = net.nodes.join(before, "origin", "left")
    origins = F.when(F.col("origin").isNotNull(), F.array("origin")).otherwise(F.array().cast("array<long>"))
    return joined.select(F.col("id").alias("new_id"), "origin", origins.alias("origins"), F.col(role).alias("role"), distance("x", "y", "ox", "oy").alias("displacement"))


def build_variant(net: Network, family: str, level: float, seed: int, store: Store, steps: list[dict] | None = None, **how) -> tuple[Network, DataFrame]:
    """A perturbed copy and its provenance, written once."""
    if family == "identity":
        made = identity(net)
    elif family == "composite":
        made = composite(net, steps or [], level, seed)
    else:
        name = {"jitter": "sigma", "warp": "amplitude", "densify": "fraction"}[family]
        made = FAMILIES[family](identity(net), **{name: level}, seed=seed, **how)
    made = Network(store.cut(made.nodes, f"{family}-nodes"), store.cut(made.edges, f"{family}-edges"))
    return made, provenance(made, net.nodes)
