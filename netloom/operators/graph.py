"""Graph operators as joins and aggregations on edge tables; each round of an iteration is written, so lineage stays short."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import Store


def canonical(edges: DataFrame, order: str | None = None) -> DataFrame:
    """A simple undirected graph: one row for each pair with src <= dst, the last by order if given; self-loops stay."""
    flat = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    if order is None:
        return flat.select("src", "dst").distinct()
    others = [c for c in flat.columns if c not in ("src", "dst")]
    return flat.groupBy("src", "dst").agg(F.max_by(F.struct(*others), order).alias("r")).select("src", "dst", "r.*")


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without self-loops."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree); a self-loop counts twice, a node without edges has 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def consistent(edges: DataFrame) -> bool:
    """Whether every edge of a list in both directions has its counterpart."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return not edges.select("src", "dst").join(back, ["src", "dst"], "left_anti").limit(1).count()


def has_edge(edges: DataFrame, a: int, b: int) -> bool:
    return bool(edges.where((F.least("src", "dst") == min(a, b)) & (F.greatest("src", "dst") == max(a, b))).limit(1).count())


def clique(nodes: DataFrame) -> DataFrame:
    """edges(src, dst) between all nodes(id)."""
    return nodes.select(F.col("id").alias("src")).join(nodes.select(F.col("id").alias("dst")), F.col("src") < F.col("dst"))


def degree_distribution(deg: DataFrame) -> DataFrame:
    """Shares in percent of degree 1, 2, 3 and 4 or more, mean degree, and the entropy of the degrees in bits."""
    per = deg.groupBy("degree").agg(F.count("*").alias("c"))
    total = per.agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    share = lambda cond: 100.0 * F.sum(F.when(cond, F.col("c")).otherwise(0)) / F.first("n")
    d = F.col("degree")
    return per.crossJoin(F.broadcast(total)).agg(share(d == 1).alias("deg1"), share(d == 2).alias("deg2"), share(d == 3).alias("deg3"), share(d >= 4).alias("deg4p"), (F.sum(d * F.col("c")) / F.first("n")).alias("mean_degree"), (-F.sum(p * F.log2(p))).alias("entropy"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int, store: Store, name: str = "hops") -> DataFrame:
    """seeds(root, id) to (root, id, depth): breadth first from each root, up to so many steps."""
    near = store.cut(symmetric(edges).distinct(), f"{name}-edges")
    seen = front = store.cut(seeds.select("root", "id", F.lit(0).alias("depth")).distinct(), f"{name}-0")
    for k in range(1, depth + 1):
        step = front.join(near, front["id"] == near["a"]).select("root", F.col("b").alias("id")).distinct()
        front = store.cut(step.join(seen, ["root", "id"], "left_anti").select("root", "id", F.lit(k).alias("depth")), f"{name}-{k}")
        seen = seen.unionByName(front)
    return seen


def halo(edges: DataFrame, core: DataFrame, depth: int, store: Store) -> DataFrame:
    """(id, depth) of the core, at 0, and of all nodes within so many steps of it."""
    return hops(edges, core.select(F.lit(0).alias("root"), "id"), depth, store, "halo").select("id", "depth")


def rings(nodes: DataFrame, edges: DataFrame, depth: int, store: Store) -> DataFrame:
    """(root, depth, degrees): sorted degrees of the nodes at exactly so many steps."""
    found = hops(edges, nodes.select(F.col("id").alias("root"), "id"), depth, store, "rings")
    deg = degrees(nodes, edges)
    return found.join(deg, "id").groupBy("root", "depth").agg(F.array_sort(F.collect_list("degree")).alias("degrees"))


def colours(nodes: DataFrame, edges: DataFrame, rounds: int, store: Store) -> DataFrame:
    """(h, id, colour) of Weisfeiler-Leman refinement from degrees. A colour is named by the least node that has it, so no order over all is needed."""
    near = store.cut(symmetric(edges).distinct(), "wl-edges")
    deg = degrees(nodes, edges)
    named = deg.groupBy("degree").agg(F.min("id").alias("colour"))
    now = store.cut(deg.join(named, "degree").select(F.lit(0).alias("h"), "id", "colour"), "wl-0")
    out = now
    for h in range(1, rounds + 1):
        around = near.join(now.select(F.col("id").alias("b"), "colour"), "b").groupBy("a").agg(F.array_sort(F.collect_list("colour")).alias("around"))
        signed = now.join(around, now["id"] == around["a"], "left").select("id", "colour", F.coalesce("around", F.array().cast("array<long>")).alias("around"))
        named = signed.groupBy("colour", "around").agg(F.min("id").alias("new"))
        now = store.cut(signed.join(named, ["colour", "around"]).select(F.lit(h).alias("h"), "id", F.col("new").alias("colour")), f"wl-{h}")
        out = out.unionByName(now)
    return out


def colour_statistics(coloured: DataFrame) -> DataFrame:
    """For each h: distinct colours over nodes, and the percentage of nodes that share theirs."""
    per = coloured.groupBy("h", "colour").agg(F.count("*").alias("c"))
    return per.groupBy("h").agg((F.count("*") / F.sum("c")).alias("ratio"), (100.0 * F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("shared"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coefficient): of the pairs of its neighbours the share that is joined; 0 below two neighbours."""
    e = canonical(edges).where("src <> dst")
    # edges are directed from the lower degree to the higher, so a hub is never the apex of its pairs
    deg = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    d1, d2 = deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("d").alias("dd"))
    both = e.join(d1, "src").join(d2, "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    out = both.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = out.alias("p").join(out.alias("q"), F.expr("p.u = q.u and p.v < q.v")).select(F.col("p.u").alias("u"), F.col("p.v").alias("v"), F.col("q.v").alias("w"))
    closed = wedges.join(e, (F.col("v") == F.col("src")) & (F.col("w") == F.col("dst"))).select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    joined = nodes.select("id").join(deg, "id", "left").join(closed, "id", "left")
    return joined.select("id", F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """Gini coefficient and coefficient of variation of a column. Equal values are counted first; ranks follow from their running sums."""
    per = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # distinct values only
    ranked = per.withColumn("last", F.sum("c").over(w))
    weight = F.col("v") * F.col("c") * (2 * F.col("last") - F.col("c") + 1) / 2.0  # value times the sum of its ranks
    sums = ranked.agg(F.sum(weight).alias("s"), F.sum(F.col("v") * F.col("c")).alias("t"), F.sum("c").alias("n"), F.sum(F.col("v") * F.col("v") * F.col("c")).alias("q"))
    mean = F.col("t") / F.col("n")
    g = F.when(F.col("t") == 0, 0.0).otherwise(2.0 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1.0) / F.col("n"))
    return sums.select(g.alias("gini"), F.when(F.col("t") == 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)) / mean).alias("cv"))


def _numbered(nodes: DataFrame, store: Store) -> DataFrame:
    """(id, number): the places of nodes in the order of their ids, from 0 without gaps."""
    placed = nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    placed = store.cut(placed.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("r")), "numbered")
    first = placed.groupBy("p").agg(F.count("*").alias("c")).select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("first"))  # a row a partition
    return placed.join(F.broadcast(first), "p").select("id", (F.col("first") + F.col("r")).cast("int").alias("number"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int, seed: int = 42, batch: int = 8) -> DataFrame:
    """(id, betweenness): shortest-path betweenness estimated from so many source nodes, all if there are no more, normalised.

    Sources are the first in the order of a keyed hash. Each task gets some of them and the graph, 8 bytes an edge and some 50 a node, which it has to hold; it
    does not pass through the driver.
    """
    from ..functions import uniform

    store = Store(nodes.sparkSession, "betweenness")
    numbered = store.cut(_numbered(nodes, store), "numbers")
    n = numbered.count()
    k = min(sources, n)
    tasks = max(1, k // batch)
    a, b = (numbered.select(F.col("id").alias(e), F.col("number").alias(c)) for e, c in (("src", "a"), ("dst", "b")))
    once = canonical(edges.select("src", "dst")).where("src <> dst").join(a, "src").join(b, "dst").select("a", "b")
    picked = nodes.select("id").orderBy(uniform(seed, "id"), "id").limit(k).join(numbered, "id")
    # a source is an edge to nowhere
    picked = picked.select((F.row_number().over(Window.orderBy("number")) % tasks).alias("task"), F.col("number").alias("a"), F.lit(-1).alias("b"))
    sent = once.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "a", "b").unionByName(picked)

    def from_sources(table: pa.Table) -> pa.Table:
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        own = np.sort(a[b < 0])
        a, b = a[b >= 0], b[b >= 0]
        # both directions in order, a number each
        ends = np.empty(2 * len(a), np.int64)
        ends[: len(a)], ends[len(a) :] = a, b
        ends *= n
        ends[: len(a)] += b
        ends[len(a) :] += a
        del a, b
        ends.sort()
        heads = np.searchsorted(ends, np.arange(n + 1, dtype=np.int64) * n)
        ends %= n
        to = ends.astype(np.int32)
        del ends
        total = np.zeros(n)
        for s in own.tolist():
            total += dependencies(s, heads, to)
        at = np.flatnonzero(total)
        return pa.table({"number": pa.array(at.astype(np.int32)), "d": pa.array(total[at])})

    sums = sent.groupBy("task").applyInArrow(from_sources, "number int, d double").groupBy("number").agg(F.sum("d").alias("d")).join(numbered, "number").select("id", "d")
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def dependencies(source: int, heads: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How much of the shortest paths from source passes through each node; a breadth-first pass and one back, level by level."""
    n = len(heads) - 1
    depth, paths = np.full(n, -1, np.int32), np.zeros(n)
    depth[source], paths[source] = 0, 1.0
    levels, front = [], np.array([source])
    while len(front):
        count = heads[front + 1] - heads[front]
        u = np.repeat(front, count)
        v = to[np.repeat(heads[front] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        fresh = np.unique(v[depth[v] < 0])
        depth[fresh] = depth[front[0]] + 1
        step = depth[v] == depth[front[0]] + 1
        np.add.at(paths, v[step], paths[u[step]])
        levels.append((u[step], v[step]))
        front = fresh
    out = np.zeros(n)
    for u, v in reversed(levels):
        np.add.at(out, u, paths[u] / paths[v] * (1 + out[v]))
    out[source] = 0
    return out


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges within keep(id), and the severed edges with exactly one end there."""
    k = keep.select("id").distinct()
    inside = edges.join(k.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(k.select(F.col("id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    s, d = F.coalesce("s", F.lit(False)), F.coalesce("d", F.lit(False))
    return nodes.join(k, "id", "left_semi"), inside.where(s & d).select("src", "dst"), inside.where(s != d).select("src", "dst")
