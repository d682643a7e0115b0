"""Structural identity by degree lists of growing neighbourhoods, layer graphs of similar nodes, and walks between the layers."""

from __future__ import annotations

import functools
import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import TWO_52, uniform
from ..store import Store, small
from .graph import degrees, rings


def degree_lists(nodes: DataFrame, edges: DataFrame, layers: int, store: Store) -> DataFrame:
    """(root, depth, degrees): sorted degrees at each distance from 0 to layers."""
    return rings(nodes, edges, layers, store)


def compact(lists: DataFrame) -> DataFrame:
    """Degree lists as (degree, frequency) pairs in order."""
    each = lists.select("root", "depth", F.explode("degrees").alias("degree")).groupBy("root", "depth", "degree").agg(F.count("*").alias("freq"))
    return each.groupBy("root", "depth").agg(F.array_sort(F.collect_list(F.struct("degree", "freq"))).alias("pairs"))


def cost(a: float, b: float) -> float:
    return (max(a, b) + 0.5) / (min(a, b) + 0.5) - 1


def cost_column(a: str, b: str, fa: str | None = None, fb: str | None = None, least: bool = False):
    """cost of two degrees as a column; of compact entries times the larger frequency, or with least the smaller."""
    out = (F.greatest(a, b) + 0.5) / (F.least(a, b) + 0.5) - 1
    return out if fa is None else out * (F.least(fa, fb) if least else F.greatest(fa, fb))


def triangular(nodes: DataFrame) -> DataFrame:
    """(v, u) with v < u: all pairs of nodes, for networks that are small enough to do without candidates."""
    return nodes.select(F.col("id").alias("v")).join(nodes.select(F.col("id").alias("u")), F.col("v") < F.col("u"))


def candidates(degree: DataFrame, store: Store, count: int | None = None) -> DataFrame:
    """degree(id, degree) to (v, u): for each node the floor(2 log2 n) + 1 others of nearest degree, ties to the higher degree, then to the smaller id."""
    return chosen(degree, store, count).select("v", F.explode("us").alias("u"))


def chosen(degree: DataFrame, store: Store, count: int | None = None) -> DataFrame:
    """(v, us): the candidates of a node as one row, nearest first.

    Nodes are ranked by (degree, id); only those within `count` ranks on either side can be among the nearest, so the join goes by rank blocks. The
    tables of degrees, not of nodes, are what is ordered in one task.
    """
    n = degree.count()
    m = count or (int(2 * np.log2(n)) + 1 if n > 1 else 0)
    per = degree.groupBy("degree").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.sum("c").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"))
    # of each degree only the first m + 1 nodes by id can be anyone's candidates
    inside = degree.withColumn("r", F.row_number().over(Window.partitionBy("degree").orderBy("id")))
    offered = store.cut(inside.where(F.col("r") <= m + 1).select("degree", F.col("id").alias("u")), "offered")
    # degrees that a node of degree d may need: outward until m + 1 nodes are counted
    capped = store.cut(before.select("degree", F.least("c", F.lit(m + 1)).alias("c"), F.col("before").alias("b")), "degrees")
    up = capped.alias("d").join(capped.alias("o"), F.expr(f"o.degree >= d.degree and o.b <= d.b + d.c + {m + 1} and o.degree <> d.degree")).select(F.col("d.degree").alias("degree"), F.col("o.degree").alias("other"))
    down = capped.alias("d").join(capped.alias("o"), F.expr(f"o.degree < d.degree and d.b - o.b - o.c <= {m + 1}")).select(F.col("d.degree").alias("degree"), F.col("o.degree").alias("other"))
    reach = up.unionByName(down).unionByName(capped.select("degree", F.col("degree").alias("other")))
    # the order is the same for all nodes of one degree but for the node itself
    pool = reach.join(offered.withColumnRenamed("degree", "other"), "other")
    order = Window.partitionBy("degree").orderBy(F.abs(F.col("other") - F.col("degree")), F.desc("other"), "u")
    pool = pool.withColumn("r", F.row_number().over(order)).where(F.col("r") <= m + 1)
    pool = pool.groupBy("degree").agg(F.array_sort(F.collect_list(F.struct("r", "u"))).alias("pool"))
    mine = degree.join(pool, "degree").select(F.col("id").alias("v"), F.slice(F.filter("pool", lambda x: x["u"] != F.col("id")), 1, m).alias("pool"))
    return mine.select("v", F.col("pool.u").alias("us"))


def dtw(a: np.ndarray, b: np.ndarray, fa: np.ndarray | None = None, fb: np.ndarray | None = None, radius: int = 1) -> float:
    """Dynamic time warping of two degree lists, coarse to fine: the path of lists of half the length, widened by radius, bounds the path."""
    fa, fb = (np.ones(len(x)) if f is None else f for x, f in ((a, fa), (b, fb)))

    def window_of(la: int, lb: int, va: np.ndarray, vb: np.ndarray):
        if la <= radius + 2 or lb <= radius + 2:
            return None
        half = lambda x: (x[: len(x) // 2 * 2 : 2] + x[1 : len(x) // 2 * 2 : 2]) / 2
        pa_, pb_ = np.stack([half(r) for r in va]), np.stack([half(r) for r in vb])
        _, path = solve(pa_, pb_)
        cells = {(i + di, j + dj) for i, j in path for di in range(-radius, radius + 1) for dj in range(-radius, radius + 1)}
        fine = {(2 * i + di, 2 * j + dj) for i, j in cells for di in (0, 1) for dj in (0, 1)}
        return sorted((i, j) for i, j in fine if 0 <= i < la and 0 <= j < lb)

    def solve(va: np.ndarray, vb: np.ndarray):
        la, lb = va.shape[1], vb.shape[1]
        cells = window_of(la, lb, va, vb) or [(i, j) for i in range(la) for j in range(lb)]
        best = {(-1, -1): (0.0, None)}
        for i, j in cells:
            prior = min(((best[p][0], p) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p in best), default=None)
            if prior is None:
                continue
            best[i, j] = (prior[0] + cost(va[0, i], vb[0, j]) * max(va[1, i], vb[1, j]), prior[1])
        path, at = [], (la - 1, lb - 1)
        while at != (-1, -1):
            path.append(at)
            at = best[at][1]
        return best[la - 1, lb - 1][0], path[::-1]

    return float(solve(np.stack([a, fa]), np.stack([b, fb]))[0])


def _layer_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, float] = {}
    for batch in batches:
        out = []
        for la, lb in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            key = (tuple((p["degree"], p["freq"]) for p in la), tuple((p["degree"], p["freq"]) for p in lb))
            if key not in known:
                if len(known) > 200_000:
                    known.clear()
                x, y = (np.array(k, float).T for k in key)
                known[key] = dtw(x[0], y[0], x[1], y[1])
            out.append(known[key])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.float64())], names=["v", "u", "depth", "cost"])


def layer_distances(pairs: DataFrame, compact_lists: DataFrame, store: Store) -> DataFrame:
    """pairs(v, u) to (v, u, depth, f): warped distance of the degree lists, summed from layer 0 up to each layer that both nodes have."""
    a = compact_lists.select(F.col("root").alias("v"), "depth", F.col("pairs").alias("lv"))
    b = compact_lists.select(F.col("root").alias("u"), F.col("depth").alias("d2"), F.col("pairs").alias("lu"))
    joined = pairs.join(a, "v").join(b, (pairs["u"] == b["u"]) & (F.col("depth") == F.col("d2"))).select("v", pairs["u"], "depth", "lv", "lu")
    costs = store.cut(joined.mapInArrow(_layer_costs, "v long, u long, depth int, cost double"), "costs")
    w = Window.partitionBy("v", "u").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return costs.select("v", "u", "depth", F.sum("cost").over(w).alias("f"))


def layer_graph(distances: DataFrame) -> DataFrame:
    """(depth, v, u, w): neighbours both ways, weight exp(-f) over the sum of the node's weights in the layer. A pair that both ends chose counts twice."""
    back = distances.select(F.col("u").alias("v"), F.col("v").alias("u"), "depth", "f")
    both = distances.select("v", "u", "depth", "f").unionByName(back).select("depth", "v", "u", F.exp(-F.col("f")).alias("e"))
    return both.select("depth", "v", "u", (F.col("e") / F.sum("e").over(Window.partitionBy("depth", "v"))).alias("w"))


#: Nodes up to which candidates' lists are broadcast, and distinct lists up to which they go to every task.
HUBS, LISTS = 20_000, 1_000_000
#: Costs of pairs of lists that a Python worker knows, by their hashes; kept from task to task.
_KNOWN: dict[tuple[int, int], float] = {}


def _costs(lists: tuple, ka: np.ndarray, ia: np.ndarray, kb: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Costs of the lists with hash ka[ia] against those with hash kb[ib]; each pair is computed once."""
    names, place, degree, freq = lists

    def one(h: int) -> tuple[np.ndarray, np.ndarray]:
        k = int(np.searchsorted(names, h))
        return degree[place[k] : place[k + 1]], freq[place[k] : place[k + 1]]

    found, which = np.unique(ia * len(kb) + ib, return_inverse=True)
    if len(_KNOWN) > 2_000_000:
        _KNOWN.clear()
    costs = np.empty(len(found))
    for k, (x, y) in enumerate(zip(ka[found // len(kb)].tolist(), kb[found % len(kb)].tolist(), strict=True)):
        if (x, y) not in _KNOWN:
            (a, fa), (b, fb) = one(x), one(y)
            _KNOWN[x, y] = dtw(a, b, fa, fb)
        costs[k] = _KNOWN[x, y]
    return costs[which]


def _summed(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Costs by layer, each row's from layer 0 on, as sums up to the layer: of a row by itself, in the order of layers."""
    for d in range(1, int(at.max(initial=-1)) + 1):
        here = np.flatnonzero(at == d)
        f[here] += f[here - 1]
    return f


def _summed_costs(lists):
    """Rows (v, u, hashes of the lists of v, of u) to (v, u, f): costs summed from layer 0 up to each layer that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            na, nb = (np.asarray(x.value_lengths()).astype(np.int64) for x in (a, b))
            both = np.minimum(na, nb)
            row = np.repeat(np.arange(len(both)), both)
            at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
            ha, hb = (np.asarray(x.flatten())[(np.cumsum(n) - n)[row] + at] for x, n in ((a, na), (b, nb)))
            f = _summed(_costs(lists.value, *np.unique(ha, return_inverse=True), *np.unique(hb, return_inverse=True)), at)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(both)]).astype(np.int32)), pa.array(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["v", "u", "f"])

    return run


def _hashed(compact_lists: DataFrame, store: Store) -> tuple[DataFrame, tuple | None]:
    """(root, l): each node's lists by their hashes, in order of depth; and the distinct lists by hash as arrays, unless they are more than LISTS."""
    hashed = store.cut(compact_lists.select("root", "depth", "pairs", F.xxhash64("pairs").alias("h")), "hashed")
    nodes = hashed.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("depth", "h"))).alias("l")).select("root", F.col("l.h").alias("l"))
    distinct = hashed.groupBy("h").agg(F.any_value("pairs").alias("pairs"))
    if distinct.count() > LISTS:
        return nodes, None
    flat = distinct.orderBy("h").select("h", F.col("pairs.degree").alias("degree"), F.col("pairs.freq").alias("freq")).toArrow().combine_chunks()
    column = lambda c: flat[c].combine_chunks() if isinstance(flat[c], pa.ChunkedArray) else flat[c]
    places = np.concatenate([[0], np.cumsum(np.asarray(column("degree").value_lengths()).astype(np.int64))])
    return nodes, (np.asarray(column("h")), places, *[np.asarray(column(c).flatten()).astype(float) for c in ("degree", "freq")])


def candidate_layers(pairs: DataFrame, compact_lists: DataFrame, store: Store) -> DataFrame:
    """layer_graph(layer_distances(pairs, compact_lists)) for pairs(v, u) among few u, as candidates() makes them; a node's depths go from 0 without gaps.

    All layers of a pair are one row, lists go by their hash, and weights need the nodes' sums only, so that no row of a layer is shuffled.
    """
    nodes, known = _hashed(compact_lists, store)
    if known is None:
        return layer_graph(layer_distances(pairs, compact_lists, store))
    lists = store.spark.sparkContext.broadcast(known)
    nodes = store.cut(nodes, "node-lists")
    few = store.cut(pairs.select("u").distinct(), "few")
    theirs = lambda t, key: small(t.join(few, t[key] == few["u"], "left_semi"), HUBS)
    joined = pairs.join(theirs(nodes, "root").select(F.col("root").alias("u"), F.col("l").alias("lu")), "u").join(nodes.select(F.col("root").alias("v"), F.col("l").alias("lv")), "v")
    f = store.cut(joined.select("v", "u", "lv", "lu").mapInArrow(_summed_costs(lists), "v long, u long, f array<double>"), "summed")
    each = f.select("v", "u", F.posexplode("f").alias("depth", "f"))
    sums = each.select("depth", "v", "f").unionByName(each.select("depth", F.col("u").alias("v"), "f")).groupBy("depth", "v").agg(F.sum(F.exp(-F.col("f"))).alias("s"))
    sums = store.cut(sums.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("depth", "s"))).alias("s")).select("v", F.col("s.s").alias("s")), "sums")
    summed = f.join(theirs(sums, "v").select(F.col("v").alias("u"), F.col("s").alias("su")), "u").join(sums.withColumnRenamed("s", "sv"), "v")
    ends = F.array(*[F.struct(F.col(a).alias("v"), F.col(b).alias("u"), F.col(s).alias("s")) for a, b, s in (("v", "u", "sv"), ("u", "v", "su"))])
    both = summed.select("f", F.explode(ends).alias("e")).select("e.*", F.posexplode("f").alias("depth", "f"))
    return both.select("depth", "v", "u", (F.exp(-F.col("f")) / F.get("s", F.col("depth"))).alias("w"))


def gamma(layers: DataFrame) -> DataFrame:
    """(depth, v, gamma): how many of the node's edges weigh more than the layer's average."""
    mean = layers.groupBy("depth").agg(F.avg("w").alias("mean"))
    return layers.join(F.broadcast(mean), "depth").groupBy("depth", "v").agg(F.count_if(F.col("w") > F.col("mean")).alias("gamma"))


def move_up(g):
    """Probability of going up rather than down from a node with so many above-average edges."""
    x = F.log(g + F.lit(float(np.e)))
    return x / (1.0 + x)


#: Choices of a node that one row of the walks' table holds, about; and draws looked at in a round.
CHOICES, DRAWS = 8, 12


def walk_table(layers: DataFrame, store: Store) -> DataFrame:
    """(depth, v, bucket, choices): the neighbours of a node in a layer by running weight, dealt by equal parts of [0, 1).

    A draw s finds its neighbour in part floor(s * parts) alone, however many neighbours the node has: a hub's list is never met as a whole. Each
    choice is (cdf, u, meta of u); the meta of a node lists, by depth, its number of parts and its gamma, null where it has no neighbours.
    """
    run = Window.partitionBy("depth", "v").orderBy("u", "w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = layers.withColumn("cdf", F.sum("w").over(run)).withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("depth", "v")) / CHOICES).cast("int"))
    sized = store.cut(sized, "cdf")
    nodes = sized.groupBy("depth", "v").agg(F.first("parts").alias("parts"), F.max("cdf").alias("last")).join(gamma(layers), ["depth", "v"])
    nodes = store.cut(nodes, "layer-nodes")
    each = F.struct("depth", F.struct("parts", "gamma").alias("m"))
    by_depth = F.map_from_entries(F.collect_list(each))
    meta = nodes.groupBy("v").agg(by_depth.alias("m"), F.max("depth").alias("top")).select("v", F.transform(F.sequence(F.lit(0), "top"), lambda d: F.element_at("m", d)).alias("meta"))
    meta = store.cut(meta, "layer-meta")
    # the last choice of a node also takes what rounding leaves up to 1
    bounds = sized.join(nodes.select("depth", "v", "last"), ["depth", "v"])
    low = F.greatest(F.floor((F.col("cdf") - F.col("w")) * F.col("parts") - 1e-6), F.lit(0))
    high = F.when(F.col("cdf") >= F.col("last"), F.col("parts") - 1).otherwise(F.least(F.floor(F.col("cdf") * F.col("parts") + 1e-6), F.col("parts") - 1))
    dealt = bounds.select("depth", "v", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("bucket"), "cdf", "u")
    dealt = dealt.join(meta.select(F.col("v").alias("u"), "meta"), "u")
    return store.cut(dealt.groupBy("depth", "v", "bucket").agg(F.array_sort(F.collect_list(F.struct("cdf", "u", "meta"))).alias("choices")), "layer-table")


def layer_walks(layers: DataFrame, nodes: DataFrame, store: Store, per_node: int = 10, length: int = 80, stay: float = 0.3, seed: int = 42, cut_every: int = 6) -> DataFrame:
    """nodes(id) to (walk, tokens): walks of `length` nodes; with probability `stay` a step in the layer, else a move between layers.

    Moving does not lengthen a walk; a walk at depth 0 without neighbours there ends. Every draw is a hash of (seed, walk, draw): of the least neighbour
    u whose running weight reaches the draw, or the last. Walks advance by a join a step; moves between layers need none, as a walk carries what its
    node has in each layer. Steps are written as they are made and collected once.
    """
    table = walk_table(layers, store)
    meta = store.spark.read.parquet(store.paths["layer-meta"])
    start = nodes.select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("i")).join(meta, "v", "left")
    now = start.select(F.concat_ws("#", "v", "i").alias("walk"), "v", "meta", F.lit(0).alias("depth"), F.lit(0).alias("draw"), F.lit(1).alias("size"), F.array("v").alias("recent"))
    here = lambda state: F.get("meta", state["depth"])

    def draw(state, j):
        """One draw of a walk that has neither stepped (at) nor ended."""
        r, s = uniform(seed, "walk", j, F.lit(1)), uniform(seed, "walk", j, F.lit(2))
        some = here(state)
        up = (s < move_up(F.coalesce(some["gamma"], F.lit(0)))) & (state["depth"] < F.size("meta") - 1)
        moved = F.when(up, state["depth"] + 1).otherwise(F.greatest(state["depth"] - 1, F.lit(0)))
        ends = some.isNull() & (state["depth"] == 0)
        steps = (r < stay) & some.isNotNull()
        over = state["ended"] | (state["at"] >= 0)
        depth = F.when(over | ends | steps, state["depth"]).otherwise(moved)
        return F.struct(depth.cast("int").alias("depth"), F.when(~over & steps, j).otherwise(state["at"]).cast("int").alias("at"), (state["ended"] | (~over & ends)).alias("ended"))

    done, k = [], 0
    while True:
        begin = F.struct(F.col("depth").cast("int").alias("depth"), F.lit(-1).alias("at"), F.lit(False).alias("ended"))
        state = F.aggregate(F.sequence(F.col("draw"), F.col("draw") + DRAWS - 1), begin, draw)
        live = (F.col("size") < length) & F.col("meta").isNotNull()
        moved = now.withColumn("state", F.when(live, state)).withColumn("s", uniform(seed, "walk", F.col("state.at"), F.lit(2)))
        bucket = F.when(F.col("state.at") >= 0, F.least(F.floor(F.col("s") * here(F.col("state"))["parts"]), here(F.col("state"))["parts"] - 1).cast("int"))
        moved = moved.withColumn("to", F.struct(F.col("state.depth").alias("depth"), F.col("v"), bucket.alias("bucket")))
        joined = moved.join(table.select(F.struct("depth", "v", "bucket").alias("to"), "choices"), "to", "left")
        pick = F.coalesce(F.get(F.filter("choices", lambda x: x["cdf"] >= F.col("s")), F.lit(0)), F.element_at("choices", -1))
        joined = joined.withColumn("pick", pick)
        stepped = F.col("pick").isNotNull()
        now = joined.select(
            "walk",
            F.coalesce("pick.u", "v").alias("v"),
            F.when(F.coalesce("state.ended", F.lit(True)), F.lit(None)).when(stepped, F.col("pick.meta")).otherwise(F.col("meta")).alias("meta"),
            F.coalesce("state.depth", "depth").alias("depth"),
            F.when(stepped, F.col("state.at") + 1).otherwise(F.col("draw") + DRAWS).alias("draw"),
            (F.col("size") + stepped.cast("int")).alias("size"),
            F.when(stepped, F.concat("recent", F.array("pick.u"))).otherwise(F.col("recent")).alias("recent"),
        )
        k += 1
        if k % cut_every == 0:
            now = store.cut(now, f"walks-{k}")
            done.append(now.select("walk", F.lit(k).alias("k"), "recent"))
            now = now.where((F.col("size") < length) & F.col("meta").isNotNull()).withColumn("recent", F.array().cast("array<long>"))
            if not now.limit(1).count():
                break
    steps = functools.reduce(DataFrame.unionByName, done)
    return steps.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("k", "recent"))).alias("parts")).select("walk", F.transform(F.flatten("parts.recent"), lambda x: x.cast("string")).alias("tokens"))


#: Nodes of one part of candidate_walks, about.
PART_NODES = 8192
_STATE = "walk string, part int, at long, depth int, draw int, s double, size int, recent array<long>"


def _parted_costs(lists, hubs, bounds: np.ndarray):
    """Rows (v, us, l) to (part, own, v, us, n, f): the summed costs f of v and each of us, n layers of each, one after the other.

    A row lies in the part of v. If v is a candidate itself, us are its neighbours too, so rows that are not own say so in their parts: v is then one of us.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, place, hashes = hubs.value
        kb, slot = np.unique(hashes, return_inverse=True)
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, len(b), 2048)):
            v, u, la = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
            nu, nl = (np.asarray(batch.column(c).value_lengths()).astype(np.int64) for c in (1, 2))
            ka, ia = np.unique(la, return_inverse=True)
            row, hub = np.repeat(np.arange(len(v)), nu), np.searchsorted(ids, u)
            n = np.minimum(nl[row], np.diff(place)[hub])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            f = _summed(_costs(lists.value, ka, ia[np.repeat((np.cumsum(nl) - nl)[row], n) + at], kb, slot[np.repeat(place[hub], n) + at]), at)

            def rows(own: bool, v: np.ndarray, u: np.ndarray, nu: np.ndarray, n: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
                ends = lambda k: pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32))
                per = np.add.reduceat(np.append(n, 0), np.cumsum(nu) - nu) * (nu > 0) if len(nu) else nu
                told = [pa.array(np.searchsorted(bounds, v).astype(np.int32)), pa.array(np.full(len(v), own)), pa.array(v), pa.ListArray.from_arrays(ends(nu), pa.array(u)), pa.ListArray.from_arrays(ends(nu), pa.array(n.astype(np.int32))), pa.ListArray.from_arrays(ends(per), pa.array(f))]
                return pa.RecordBatch.from_arrays(told, names=["part", "own", "v", "us", "n", "f"])

            yield rows(True, v, u, nu, n, f)
            both = np.isin(v, ids)[row]
            if both.any():
                yield rows(False, u[both], v[row][both], np.ones(both.sum(), np.int64), n[both], f[np.repeat(both, n)])

    return run


class _Part:
    """Rows of a part, or of a piece of it, as arrays over (row, one of us): weights not yet divided by a node's sum, by layer, and 0 in layers that are missing."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, ids: np.ndarray, depths: int):
        column = lambda c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]
        self.v, self.own = np.asarray(column("v")), column("own").to_numpy(zero_copy_only=False)
        self.u, self.n = np.asarray(column("us").flatten()), np.asarray(column("n").flatten()).astype(np.int64)
        self.count = np.asarray(column("us").value_lengths()).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.row = np.repeat(np.arange(len(self.v)), self.count)
        self.hub = np.searchsorted(ids, self.u)
        self.e = np.zeros((len(self.u), depths))
        of = np.repeat(np.arange(len(self.u)), self.n)
        self.e[of, np.arange(len(of)) - (np.cumsum(self.n) - self.n)[of]] = np.exp(-np.asarray(column("f").flatten()))

    def has(self) -> np.ndarray:
        return self.n[:, None] > np.arange(self.e.shape[1])

    def per_row(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.start, axis=0) if len(x) else np.zeros((len(self.v), *x.shape[1:]), x.dtype)

    def per_hub(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hubs of these rows, by number, and the sums of their entries in order of neighbours."""
        order = np.lexsort((self.v[self.row], self.hub))
        which, first = np.unique(self.hub[order], return_index=True)
        return which, np.add.reduceat(x[order], first, axis=0)


def _sums_by_hub(hubs, depths: int):
    """A part to (part, hub, s, c): of each hub the sum of weights and number of neighbours by layer; and in a row of hub -1 the pairs (s) and the nodes that are no hubs (c) by layer."""

    def run(rows: pa.Table) -> pa.Table:
        ids = hubs.value[0]
        part = _Part(rows, ids, depths)
        which, s = part.per_hub(np.concatenate([part.e, part.has()], axis=1))
        single = part.own & ~np.isin(part.v, ids)
        nodes = (part.per_row(part.has()) > 0)[single].sum(0)
        pairs = part.has()[part.own[part.row]].sum(0)
        which, s = np.append(which, -1), np.concatenate([s, [np.concatenate([pairs, nodes])]])
        lists = lambda x, kind: pa.array(list(x.astype(kind)))
        return pa.table({"part": pa.array(np.full(len(which), rows["part"][0].as_py(), np.int32)), "hub": pa.array(which.astype(np.int32)), "s": lists(s[:, :depths], float), "c": lists(s[:, depths:], np.int64)})

    return run


def _gamma_by_hub(hubs, sums: np.ndarray, mean: np.ndarray):
    """Pieces of parts to (hub, g): how many of these neighbours of a hub weigh more than the mean, by layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _Part(batch, hubs.value[0], len(mean))
            if len(part.u):
                with np.errstate(invalid="ignore", divide="ignore"):
                    which, g = part.per_hub((part.has() & (part.e / sums[part.hub] > mean)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(list(g))], names=["hub", "g"])

    return run


def _drawn(head: str, j: int, depth: int, top: int, up: list[float], stay: float) -> tuple[int, int, float]:
    """From draw j on: the draw that steps, its layer and its number, of a walk at a node with layers up to top; head is seed and walk, as in uniform()."""
    md5, number = hashlib.md5, int.from_bytes
    while True:
        s = (number(md5(f"{head}:{j}:2".encode()).digest()[:7]) >> 4) / TWO_52
        if (number(md5(f"{head}:{j}:1".encode()).digest()[:7]) >> 4) / TWO_52 < stay:
            return j, depth, s
        depth = depth + 1 if s < up[depth] and depth < top else max(depth - 1, 0)
        j += 1


def _up(gamma: np.ndarray) -> np.ndarray:
    x = np.log(gamma + np.e)
    return x / (1 + x)


def _walked(shared, length: int, stay: float, seed: int):
    """A part and the walks that are due in it, on to their next parts; part -1 of walks that are over.

    A walk is due (s >= 0) if it steps from a hub to a neighbour in this part. From there, and at the start, it goes on to a hub, whose next step may lead to any part.
    """

    def run(rows: pa.Table, walks: pa.Table) -> pa.Table:
        if not len(walks):
            return walks.append_column("recent", pa.array([], pa.list_(pa.int64())))
        ids, tops, up_hub, sums, cum, first, last, mean = shared.value
        depths = len(mean)
        part = _Part(rows, ids, depths)
        p = walks["part"][0].as_py()
        names = [f"{seed}:{x}" for x in walks["walk"].to_pylist()]
        at, s = walks["at"].to_numpy().copy(), walks["s"].to_numpy().copy()
        depth, draw, size = (walks[c].to_numpy().astype(np.int64) for c in ("depth", "draw", "size"))
        recent: list[list[int]] = [[] for _ in names]

        def step(who: np.ndarray, to: np.ndarray) -> None:
            at[who], s[who] = to, -1.0
            size[who] += 1
            draw[who] += 1
            for i, x in zip(who.tolist(), to.tolist(), strict=True):
                recent[i].append(x)

        # from hubs to their neighbours here
        due = np.flatnonzero(s >= 0)
        if len(due):
            order = np.lexsort((part.v[part.row], part.hub))
            place = np.searchsorted(part.hub[order], np.arange(len(ids) + 1))
            h = np.searchsorted(ids, at[due])
            group = h * depths + depth[due]
            by = np.argsort(group, kind="stable")
            to = np.empty(len(due), np.int64)
            for some in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
                hub, d = int(h[some[0]]), int(depth[due[some[0]]])
                here = order[place[hub] : place[hub + 1]]
                here = here[part.n[here] > d]
                run_ = cum[hub, d, p] + np.cumsum(part.e[here, d] / sums[hub, d])
                to[some] = part.v[part.row[here[np.minimum(np.searchsorted(run_, s[due[some]]), len(here) - 1)]]]
            step(due, to)
        # from other nodes to hubs
        single = np.flatnonzero(part.own & ~np.isin(part.v, ids) & (part.count > 0))
        single = single[np.argsort(part.v[single])]
        is_hub = lambda x: (ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x) if len(ids) else np.zeros(len(x), bool)
        among = np.flatnonzero((size < length) & ~is_hub(at))
        k = np.searchsorted(part.v[single], at[among])
        known = k < len(single)
        known[known] = part.v[single][k[known]] == at[among][known]
        alone = among[~known]
        among, r = among[known], single[k[known]]
        if len(among):
            total = part.per_row(part.e)
            with np.errstate(invalid="ignore", divide="ignore"):
                up = _up(part.per_row((part.has() & (part.e / total[part.row] > mean)).astype(np.int64)))
            top = np.maximum.reduceat(part.n, part.start) - 1
            told = [_drawn(names[i], j, d, t, u, stay) for i, j, d, t, u in zip(among.tolist(), draw[among].tolist(), depth[among].tolist(), top[r].tolist(), up[r].tolist(), strict=True)]
            draw[among], depth[among] = [x[0] for x in told], [x[1] for x in told]
            drawn, width = np.array([x[2] for x in told]), int(part.count.max())
            to = np.empty(len(among), np.int64)
            for a in range(0, len(among), 4096):
                rr, dd = r[a : a + 4096], depth[among[a : a + 4096]]
                cell = part.start[rr][:, None] + np.arange(width)
                inside = np.arange(width) < part.count[rr][:, None]
                cell = np.where(inside, cell, 0)
                inside &= part.n[cell] > dd[:, None]
                run_ = np.cumsum(np.where(inside, part.e[cell, dd[:, None]], 0) / total[rr, dd][:, None], axis=1)
                hit = inside & (run_ >= drawn[a : a + 4096, None])
                pick = np.where(hit.any(1), hit.argmax(1), width - 1 - inside[:, ::-1].argmax(1))
                to[a : a + 4096] = part.u[cell[np.arange(len(rr)), pick]]
            step(among, to)
        # from hubs, as far as the part of the neighbour
        due = np.flatnonzero((size < length) & is_hub(at) & (s < 0))
        nxt = np.full(len(names), -1, np.int32)
        for i, h in zip(due.tolist(), np.searchsorted(ids, at[due]).tolist(), strict=True):
            draw[i], depth[i], s[i] = _drawn(names[i], int(draw[i]), int(depth[i]), tops[h], up_hub[h], stay)
            nxt[i] = min(max(int(np.searchsorted(cum[h, depth[i], 1:], s[i])), first[h, depth[i]]), last[h, depth[i]])
        nxt[alone] = -1
        kinds = (("part", nxt, pa.int32()), ("at", at, pa.int64()), ("depth", depth, pa.int32()), ("draw", draw, pa.int32()), ("s", s, pa.float64()), ("size", size, pa.int32()), ("recent", recent, pa.list_(pa.int64())))
        return pa.table({"walk": walks["walk"]} | {c: pa.array(x, kind) for c, x, kind in kinds})

    return run


def candidate_walks(chosen: DataFrame, compact_lists: DataFrame, nodes: DataFrame, store: Store, per_node: int = 10, length: int = 80, stay: float = 0.3, seed: int = 42, part_nodes: int = PART_NODES) -> DataFrame:
    """layer_walks(candidate_layers(pairs, compact_lists), nodes) for chosen(v, us), as chosen() makes them: few nodes, called hubs, are candidates.

    No row of a layer is made: the costs of a node and its candidates are one row, in a part of the nodes by id. Of two nodes that are neighbours one is a hub. The
    part knows the lists of its other nodes whole and a run of each hub's list, and how much weight a hub has in each part goes to all tasks. So in a round
    a walk goes from a hub to a node of the part and on to a hub.
    """
    spark, sc = store.spark, store.spark.sparkContext
    of_nodes, known = _hashed(compact_lists, store)
    picked = store.cut(chosen.where(F.size("us") > 0).select("v", F.array_sort("us").alias("us")), "chosen")
    few = store.cut(picked.select(F.explode("us").alias("u")).distinct(), "hubs")
    total = nodes.count()
    if known is None or few.count() > HUBS:
        layers = store.cut(candidate_layers(picked.select("v", F.explode("us").alias("u")), compact_lists, Store(spark, "layers")), "layers")
        return layer_walks(layers, nodes, store, per_node, length, stay, seed)
    of_nodes = store.cut(of_nodes, "of-nodes")
    hub_lists = few.join(of_nodes, few["u"] == of_nodes["root"]).select("u", "l").orderBy("u").toArrow().combine_chunks()
    flat = hub_lists["l"].combine_chunks()
    place = np.concatenate([[0], np.cumsum(np.asarray(flat.value_lengths()).astype(np.int64))])
    ids = hub_lists["u"].to_numpy()
    hubs, lists = sc.broadcast((ids, place, np.asarray(flat.flatten()))), sc.broadcast(known)
    depths = int(np.diff(place).max(initial=0))
    n_parts = max(1, -(-total // part_nodes))
    bounds = np.array(sorted(set(nodes.approxQuantile("id", [i / n_parts for i in range(1, n_parts)], 0.1 / n_parts)))) if n_parts > 1 else np.zeros(0)
    bounds = bounds.astype(np.int64)
    n_parts = len(bounds) + 1
    with store.dealt(2 * total):
        given = picked.join(of_nodes, picked["v"] == of_nodes["root"]).select("v", "us", "l")
        table = store.cut(given.mapInArrow(_parted_costs(lists, hubs, bounds), "part int, own boolean, v long, us array<long>, n array<int>, f array<double>"), "parted")
        told = table.groupBy("part").applyInArrow(_sums_by_hub(hubs, depths), "part int, hub int, s array<double>, c array<long>")
        told = store.cut(told, "hub-sums").toArrow()
    at, hub = told["part"].to_numpy(), told["hub"].to_numpy()
    stacked = lambda c: np.asarray(told[c].combine_chunks().flatten()).reshape(-1, depths)
    s, c = np.zeros((len(ids), depths, n_parts)), np.zeros((len(ids), depths, n_parts), np.int64)
    s[hub[hub >= 0], :, at[hub >= 0]], c[hub[hub >= 0], :, at[hub >= 0]] = stacked("s")[hub >= 0], stacked("c")[hub >= 0]
    sums = s.sum(2)
    pairs, singles = stacked("s")[hub < 0].sum(0), stacked("c")[hub < 0].sum(0)
    # each node's weights in a layer sum to 1, and each pair is an edge both ways
    layers = c.sum(2)
    mean = (singles + (layers > 0).sum(0)) / np.maximum(2 * pairs, 1)
    gammas = np.zeros((len(ids), depths), np.int64)
    for r in table.mapInArrow(_gamma_by_hub(hubs, sums, mean), "hub int, g array<long>").groupBy("hub").agg(*[F.sum(F.col("g")[d]).alias(f"g{d}") for d in range(depths)]).toLocalIterator():
        gammas[r["hub"]] = r[1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        cum = np.concatenate([np.zeros((len(ids), depths, 1)), np.cumsum(s / sums[:, :, None], axis=2)], axis=2)
    first, last = (c > 0).argmax(2), n_parts - 1 - (c > 0)[:, :, ::-1].argmax(2)
    shared = sc.broadcast((ids, ((layers > 0).sum(1) - 1).tolist(), _up(gammas).tolist(), sums, cum, first, last, mean))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(bounds, v).astype(np.int32)), batch.column(1)], names=["walk", "part", "at"])

    start = nodes.select(F.col("id").cast("long").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("i")).select(F.concat_ws("#", "v", "i").alias("walk"), "v")
    now = start.mapInArrow(begin, "walk string, part int, at long").select(
        "walk", "part", "at", *[F.lit(x).alias(c) for c, x in (("depth", 0), ("draw", 0), ("s", -1.0), ("size", 1))], F.array("at").alias("recent")
    )
    done, k = [now.select("walk", F.lit(0).alias("k"), "recent")], 0
    while length > 1:
        k += 1
        with store.dealt(2 * total):
            made = table.groupBy("part").cogroup(now.drop("recent").groupBy("part")).applyInArrow(_walked(shared, length, stay, seed), _STATE)
            made = store.cut(made, f"walks-{k}")
        done.append(made.select("walk", F.lit(k).alias("k"), "recent"))
        now = made.where("part >= 0")
        if not now.limit(1).count():
            break
    steps = functools.reduce(DataFrame.unionByName, done)
    return steps.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("k", "recent"))).alias("parts")).select("walk", F.transform(F.flatten("parts.recent"), lambda x: x.cast("string")).alias("tokens"))


def vectors(nodes: DataFrame, edges: DataFrame, store: Store, until_layer: int = 6, per_node: int = 10, length: int = 80, count: int | None = None, seed: int = 42, dim: int = 128, window: int = 10, epochs: int = 5) -> DataFrame:
    """(id, vec) of structural identity, end to end: degree lists, candidates, layers, walks, skip-gram."""
    from .embedding import skip_gram_hs

    lists = store.cut(compact(degree_lists(nodes, edges, until_layer, store)), "s2v-lists")
    picked = chosen(degrees(nodes, edges), store, count)
    walks = store.cut(candidate_walks(picked, lists, nodes, store, per_node, length, seed=seed), "s2v-walks")
    return skip_gram_hs(walks, dim=dim, window=window, epochs=epochs, seed=seed).select(F.col("word").cast("long").alias("id"), "vec")
