"""One-to-one alignment: scores, exact assignment by parts of the graph, anchors and orthogonal maps."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import combined, cosine, kernel, uniform, unit
from ..store import Store
from .spatial import colocated, mutual_nearest


def scored_candidates(candidates: DataFrame, e1: DataFrame, e2: DataFrame, alpha: float = 0.5, sigma: float = 5.0, mode: str = "gaussian", least: float | None = 0.0) -> DataFrame:
    """candidates(g1_id, g2_id, distance) with embedding, spatial and combined similarity; pairs without both embeddings drop out.

    Pairs with combined similarity below `least` drop out too, negative ones at 0 among them.
    """
    a, b = e1.select(F.col("id").alias("g1_id"), F.col("vec").alias("v1")), e2.select(F.col("id").alias("g2_id"), F.col("vec").alias("v2"))
    both = candidates.join(a, "g1_id").join(b, "g2_id")
    out = both.select("g1_id", "g2_id", "distance", cosine("v1", "v2").alias("embedding_sim"), kernel(F.col("distance"), sigma, mode).alias("spatial_sim"))
    out = out.withColumn("combined_sim", combined(F.col("embedding_sim"), F.col("spatial_sim"), alpha))
    return out if least is None else out.where(F.col("combined_sim") >= least)


def best_matching(rows: np.ndarray, cols: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a matching of largest total weight in a sparse bipartite graph, all weights positive."""
    r_ids, r = np.unique(rows, return_inverse=True)
    c_ids, c = np.unique(cols, return_inverse=True)
    state = Matching(r, c, weight, len(r_ids), np.ones(len(c_ids), bool))
    state.add(range(len(r_ids)))
    return [(int(r_ids[i]), int(c_ids[j])) for i, j in enumerate(state.col_of) if j >= 0]


#: What a row or column is matched with, if not with a number of the other side.
FREE, OUTSIDE = -1, -2


class Matching:
    """Matching of a part of a bipartite graph under prices u of rows and v of columns: u + v >= weight on every edge, and = weight on matched pairs.

    Rows that stay free have price 0, as columns have that are still free, so that a matching with all rows added is of largest total weight. Columns
    that are not `own` belong to other parts. Their price, which never falls, is taken for 0, and rows that would have to ask for one are not added.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, n: int, own: np.ndarray):
        order = np.lexsort((cols, rows))
        self.heads = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).tolist()
        self.to, self.weight = cols[order], weight[order]
        self.own = own.tolist()
        self.u, self.v = [0.0] * n, [0.0] * len(own)
        self.col_of, self.row_of = [FREE] * n, [FREE] * len(own)
        self.edges: dict[int, list[tuple[int, float]]] = {}

    def _of(self, i: int) -> list[tuple[int, float]]:
        found = self.edges.get(i)
        if found is None:
            a, b = self.heads[i], self.heads[i + 1]
            found = self.edges[i] = list(zip(self.to[a:b].tolist(), self.weight[a:b].tolist(), strict=True))
        return found

    def add(self, todo: Iterable[int]) -> list[int]:
        """Each row is added by a cheapest augmenting path; ending the path at a row that stays free, at no gain, is allowed.

        Returns the rows whose paths may lead out of the part; they leave everything as it was.
        """
        u, v, own, col_of, row_of = self.u, self.v, self.own, self.col_of, self.row_of
        late = []
        for s in todo:
            u[s] = max(0.0, max(w - v[j] for j, w in self._of(s)))
            dist, came = {}, {}
            done_rows, done_cols = {s: 0.0}, {}
            heap: list[tuple[float, int]] = []
            best, end = u[s], ("row", s)  # giving up a row costs its price
            i, d = s, 0.0
            leaves = False
            while True:
                for j, w in self._of(i):
                    if j not in done_cols:
                        nd = d + u[i] + v[j] - w
                        if nd < best and nd < dist.get(j, np.inf):
                            dist[j], came[j] = nd, i
                            heapq.heappush(heap, (nd, j))
                while heap and (heap[0][1] in done_cols or heap[0][0] > dist[heap[0][1]]):
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= best:
                    break
                d, j = heapq.heappop(heap)
                leaves = not own[j] or row_of[j] == OUTSIDE
                if leaves:
                    break
                done_cols[j] = d
                if row_of[j] < 0:
                    best, end = d, ("col", j)
                    break
                i = row_of[j]
                done_rows[i] = d
                if d + u[i] < best:
                    best, end = d + u[i], ("row", i)
            if leaves:
                late.append(s)
                continue
            for i, d in done_rows.items():
                u[i] -= max(0.0, best - d)
            for j, d in done_cols.items():
                v[j] += max(0.0, best - d)
            kind, at = end
            if kind == "row":
                if at == s:
                    continue
                j = col_of[at]
                col_of[at] = FREE
            else:
                j = at
            while True:
                i = came[j]
                before = col_of[i]
                col_of[i], row_of[j] = j, i
                if i == s:
                    break
                j = before
        return late


#: Rows of a strip, about; parts of a graph are solved that are some neighbouring strips wide.
STRIP_ROWS = 16384
#: Records of a part: edges (a, b, price: weight), rows and columns that are not as at first (a: which, b: its partner or null, price).
_EDGE, _ROW, _COL = 0, 1, 2


def _solve_part(width: int, shift: int):
    """Adds what rows it can of a part to the matching; gives its rows and columns. Rows that are still to be added have price null."""

    def solve(table: pa.Table) -> pa.Table:
        kind, a, p1, p2 = (table[c].to_numpy() for c in ("kind", "a", "p1", "p2"))
        b = table["b"].fill_null(0).to_numpy()
        paired = table["b"].is_valid().to_numpy()
        price = table["price"].to_numpy()
        edge, row, col = (np.flatnonzero(kind == k) for k in (_EDGE, _ROW, _COL))
        r_ids, first, r = np.unique(a[edge], return_index=True, return_inverse=True)
        c_ids, first_c, c = np.unique(b[edge], return_index=True, return_inverse=True)
        strip, strip_c = p1[edge][first], p2[edge][first_c]
        state = Matching(r, c, price[edge], len(r_ids), (strip_c + shift) // width == (p1[edge[0]] + shift) // width)
        todo = np.ones(len(r_ids), bool)
        for i, k in zip(np.searchsorted(r_ids, a[row]).tolist(), row.tolist(), strict=True):
            todo[i] = False
            state.u[i] = float(price[k])
            if paired[k]:
                state.col_of[i] = int(np.searchsorted(c_ids, b[k]))
        outside: dict[int, int] = {}  # rows of other parts that have columns of this one
        for j, k in zip(np.searchsorted(c_ids, a[col]).tolist(), col.tolist(), strict=True):
            state.v[j] = float(price[k])
            if paired[k]:
                i = int(np.searchsorted(r_ids, b[k]))
                if i < len(r_ids) and r_ids[i] == b[k]:
                    state.row_of[j] = i
                else:
                    state.row_of[j], outside[j] = OUTSIDE, int(b[k])
        late = np.zeros(len(r_ids), bool)
        late[state.add(np.flatnonzero(todo).tolist())] = True
        own = np.flatnonzero(state.own)
        own = own[np.array(state.row_of)[own] != FREE]  # free ones are as at first
        col_of, row_of = np.array(state.col_of), np.array(state.row_of)[own]
        partner = r_ids[np.maximum(row_of, 0)]
        for at in np.flatnonzero(row_of == OUTSIDE).tolist():
            partner[at] = outside[int(own[at])]
        return pa.concat_tables([
            pa.table({"kind": pa.array(np.full(len(r_ids), _ROW, np.int32)), "a": pa.array(r_ids), "b": pa.array(c_ids[np.maximum(col_of, 0)], mask=col_of == FREE), "price": pa.array(np.array(state.u), mask=late), "p1": pa.array(strip), "p2": pa.array(strip)}),
            pa.table({"kind": pa.array(np.full(len(own), _COL, np.int32)), "a": pa.array(c_ids[own]), "b": pa.array(partner), "price": pa.array(np.array(state.v)[own]), "p1": pa.array(strip_c[own]), "p2": pa.array(strip_c[own])}),
        ])

    return solve


def _strips(edges: DataFrame, along: DataFrame | None, store: Store, rows: int) -> DataFrame:
    """(g1_id, p1): strips of about so many rows, in the order of along(g1_id, along), or else of their ids."""
    ids = edges.select("g1_id").distinct()
    count = ids.count()
    if count <= rows:
        return ids.withColumn("p1", F.lit(0))
    key = along.groupBy("g1_id").agg(F.min("along").alias("along")) if along is not None else ids.select("g1_id", F.lit(0).alias("along"))
    return store.cut(ids.join(key, "g1_id", "left").repartitionByRange(-(-count // rows), "along", "g1_id").select("g1_id", F.spark_partition_id().alias("p1")), "strips")


def _chosen(costed: DataFrame, store: Store, along: DataFrame | None, strip_rows: int) -> DataFrame:
    """The pairs (g1_id, g2_id) that assign() takes of costed(g1_id, g2_id, _cost)."""
    top = costed.agg((F.max("_cost") + 1.0).alias("_top"))
    edges = costed.groupBy("g1_id", "g2_id").agg(F.min("_cost").alias("_cost")).crossJoin(F.broadcast(top)).select("g1_id", "g2_id", (F.col("_top") - F.col("_cost")).alias("weight"))
    edges = store.cut(edges, "weighted")
    placed = edges.join(_strips(edges, along, store, strip_rows), "g1_id").withColumn("p2", F.min("p1").over(Window.partitionBy("g2_id")))
    placed = store.cut(placed.select(F.lit(_EDGE).alias("kind"), F.col("g1_id").cast("long").alias("a"), F.col("g2_id").cast("long").alias("b"), F.col("weight").alias("price"), "p1", "p2"), "placed")
    store.free("weighted")
    strips = (placed.agg(F.max("p1")).first()[0] or 0) + 1
    state, k = None, 0
    while True:
        width, shift = (2, 0) if k == 0 else (2**k, 2 ** (k - 1))
        part = lambda p, w=width, s=shift: F.floor((F.col(p) + s) / w).cast("int")
        whole = strips <= width - shift
        if state is None:
            rows, done = placed.withColumn("part", part("p1")), None
        else:
            waiting = sorted({(p[0] + shift) // width for p in state.where(F.col("price").isNull()).select("p1").distinct().collect()})  # numbers of strips
            if not waiting:
                break
            known = state.where(F.col("price").isNotNull())
            rows = placed.unionByName(known).withColumn("part", part("p1")).where(F.col("part").isin(waiting))
            done = known.where(~part("p1").isin(waiting))
        made = rows.groupBy("part").applyInArrow(_solve_part(width, shift), "kind int, a long, b long, price double, p1 int, p2 int")
        after = store.cut(made if done is None else made.unionByName(done), f"state-{k}")
        if state is not None:
            store.free(f"state-{k - 1}")
        state, k = after, k + 1
        if whole:
            break
    return state.where((F.col("kind") == _ROW) & F.col("b").isNotNull()).select(F.col("a").alias("g1_id"), F.col("b").alias("g2_id"))


def assign(pairs: DataFrame, cost, store: Store, along: DataFrame | None = None, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """pairs(g1_id, g2_id, ...) to a one-to-one subset of them: the matching of largest sum of (largest cost + 1 - cost) over all pairs.

    That is the optimum of the square problem padded with cells of cost (largest + 1), and not the largest matching. Rows are dealt into strips, in the
    order of along(g1_id, along), such as a coordinate, or else of their ids. Parts of neighbouring strips are solved in parallel; rows whose augmenting
    paths would leave their part wait for the next round, whose parts are wider and have their borders elsewhere. The result is exact whatever the strips
    are, but if few paths stay within a part, the last one holds most of the graph. Of duplicate pairs the cheapest counts.
    """
    with store.dealt(along.count() if along is not None else 0):
        costed = store.cut(pairs.withColumn("_cost", cost.cast("double")), "costed")
    with store.dealt(costed.count()):
        chosen = _chosen(costed, store, along, strip_rows)
    rest = [c for c in costed.columns if c not in ("g1_id", "g2_id")]
    return costed.join(chosen, ["g1_id", "g2_id"]).groupBy("g1_id", "g2_id").agg(F.min_by(F.struct(*rest), "_cost").alias("r")).select("g1_id", "g2_id", "r.*").drop("_cost")


def _by_y(nodes1: DataFrame | None) -> DataFrame | None:
    return nodes1 if nodes1 is None else nodes1.select(F.col("id").alias("g1_id"), F.col("y").alias("along"))


def nearest_neighbour_alignment(candidates: DataFrame, store: Store, nodes1: DataFrame | None = None) -> DataFrame:
    """One-to-one matches of least total distance within the radius."""
    return assign(candidates, F.col("distance"), store, _by_y(nodes1))


def similarity_alignment(scored: DataFrame, store: Store, nodes1: DataFrame | None = None) -> DataFrame:
    return assign(scored, -F.col("combined_sim"), store, _by_y(nodes1))


def match_records(matches: DataFrame, nodes1: DataFrame, nodes2: DataFrame) -> DataFrame:
    """Matches with coordinates and distance; similarities that a method has not are null."""
    from ..functions import distance

    a = nodes1.select(F.col("id").alias("g1_id"), F.col("x").alias("x_g1"), F.col("y").alias("y_g1"))
    b = nodes2.select(F.col("id").alias("g2_id"), F.col("x").alias("x_g2"), F.col("y").alias("y_g2"))
    out = matches.join(a, "g1_id", "left").join(b, "g2_id", "left")
    sims = [(F.col(c) if c in matches.columns else F.lit(None)).cast("double").alias(c) for c in ("embedding_sim", "spatial_sim", "combined_sim")]
    return out.select("g1_id", "g2_id", "x_g1", "y_g1", "x_g2", "y_g2", distance("x_g1", "y_g1", "x_g2", "y_g2").alias("distance_m"), *sims)


def sampled(rows: DataFrame, fraction: float, seed: int, *key: str) -> DataFrame:
    """max(1, round(fraction * n)) rows: the first in the order of a keyed hash. This is a sampling operator."""
    n = rows.count()
    k = max(1, round(fraction * n)) if n else 0
    return rows.orderBy(uniform(seed, *key), *key).limit(k)


def anchors(nodes1: DataFrame, nodes2: DataFrame, mode: str, fraction: float = 0.1, seed: int = 42, tolerance: float = 0.1, bound: float = 20.0, provenance: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(g1_id, g2_id) pairs known beforehand: by provenance, unique co-location on both sides, or mutual nearest neighbours."""
    if mode == "provenance":
        pairs = provenance.where("origin is not null").select(F.col("origin").alias("g1_id"), F.col("new_id").alias("g2_id"))
    elif mode == "colocated":
        pairs = colocated(nodes1, nodes2, tolerance, both_sides=True)
    elif mode == "mutual_nn":
        pairs = mutual_nearest(nodes1, nodes2, bound)
    else:
        raise ValueError(f"unknown anchor mode: {mode}")
    out = sampled(pairs.select("g1_id", "g2_id"), fraction, seed, "g1_id", "g2_id")
    if out.count() < least:
        raise ValueError(f"fewer than {least} anchors")
    return out


def gram(anchor_pairs: DataFrame, e1: DataFrame, e2: DataFrame) -> DataFrame:
    """(i, j, value): sum over anchors of e1[i] * e2[j]; dim * dim rows, combined before the shuffle."""
    both = anchor_pairs.join(e1.select(F.col("id").alias("g1_id"), F.col("vec").alias("v1")), "g1_id").join(e2.select(F.col("id").alias("g2_id"), F.col("vec").alias("v2")), "g2_id")
    left = both.select("v2", F.posexplode("v1").alias("i", "a"))
    return left.select("i", "a", F.posexplode("v2").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("value"))


def procrustes(gram_rows: DataFrame, dim: int) -> np.ndarray:
    """The orthogonal matrix that best maps e1 onto e2, without centring or scaling."""
    m = np.zeros((dim, dim))
    for r in gram_rows.collect():  # dim * dim rows
        m[r["i"], r["j"]] = r["value"]
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def rotated(embeddings: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Vectors times matrix, at length one; zero vectors stay."""
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in col]) for col in matrix.T])
    turned = F.transform(columns, lambda c: F.aggregate(F.zip_with("vec", c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x))
    return embeddings.select("id", turned.alias("vec")).select("id", unit("vec").alias("vec"))


def top_similar(e1: DataFrame, e2: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(g1_id, g2_id, similarity): for each e1 vector the k e2 vectors of largest cosine, ties to the smaller id; by blocks of both sides."""
    n1, n2 = (max(1, -(-e.count() // block)) for e in (e1, e2))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = e1.select(F.lit(1).alias("side"), "id", F.col("vec").cast("array<double>").alias("v"), spot(n1).alias("b1"), F.explode(F.sequence(F.lit(0), F.lit(n2 - 1))).alias("b2"))
    b = e2.select(F.lit(2).alias("side"), "id", F.col("vec").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n1 - 1))).alias("b1"), spot(n2).alias("b2"))

    def compare(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        x = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(ids), -1)
        length = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        two = two[np.argsort(ids[two])]
        g1, g2, s = [], [], []
        if len(two):
            for at in range(0, len(one), 512):
                rows = one[at : at + 512]
                sim = np.round(x[rows] @ x[two].T, 12)
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                g1.append(np.repeat(ids[rows], best.shape[1]))
                g2.append(ids[two][best].ravel())
                s.append(np.take_along_axis(sim, best, 1).ravel())
        parts = [np.concatenate(o) if o else np.empty(0, t) for o, t in ((g1, np.int64), (g2, np.int64), (s, float))]
        return pa.table(dict(zip(("g1_id", "g2_id", "similarity"), parts, strict=True)))

    near = a.unionByName(b).groupBy("b1", "b2").applyInArrow(compare, "g1_id long, g2_id long, similarity double")
    w = Window.partitionBy("g1_id").orderBy(F.desc("similarity"), "g2_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def posthoc_alignment(nodes1: DataFrame, nodes2: DataFrame, e1: DataFrame, e2: DataFrame, anchor_pairs: DataFrame | None, dim: int, store: Store, candidates: str = "embedding_topk", k: int = 50, radius: float = 20.0) -> DataFrame:
    """Map e1 onto e2 by the anchors, then match one-to-one at cost 1 - cosine among the top k by embedding or within a radius.

    Without anchors the vectors are compared as they are.
    """
    from .spatial import radius_join

    if anchor_pairs is None:
        mapped = e1.select("id", unit("vec").alias("vec"))
    else:
        both = anchor_pairs.join(e1.select(F.col("id").alias("g1_id")), "g1_id", "left_semi").join(e2.select(F.col("id").alias("g2_id")), "g2_id", "left_semi")
        mapped = rotated(e1, procrustes(gram(both, e1, e2), dim))
    target = e2.select("id", unit("vec").alias("vec"))
    if candidates == "embedding_topk":
        pairs = top_similar(mapped, target, k).select("g1_id", "g2_id", "similarity")
    elif candidates == "radius":
        near = radius_join(nodes1, nodes2, radius)
        pairs = near.join(mapped.select(F.col("id").alias("g1_id"), F.col("vec").alias("v1")), "g1_id").join(target.select(F.col("id").alias("g2_id"), F.col("vec").alias("v2")), "g2_id").select("g1_id", "g2_id", F.coalesce(cosine("v1", "v2"), F.lit(0.0)).alias("similarity"))
    else:
        raise ValueError(f"unknown candidate mode: {candidates}")
    return assign(pairs, 1.0 - F.col("similarity"), store)


def candidate_statistics(candidates: DataFrame, nodes1: DataFrame) -> DataFrame:
    """How many candidates nodes have (none, 1, 2-5, more) and how far they are."""
    per = nodes1.select(F.col("id").alias("g1_id")).join(candidates.groupBy("g1_id").agg(F.count("*").alias("c")), "g1_id", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    counts = per.agg(F.count_if(F.col("c") == 0).alias("none"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c").between(2, 5)).alias("few"), F.count_if(F.col("c") > 5).alias("many"), F.avg("c").alias("count_mean"), half("c").alias("count_median"), F.max("c").alias("count_max"))
    return counts.crossJoin(candidates.agg(F.avg("distance").alias("distance_mean"), half("distance").alias("distance_median"), F.min("distance").alias("distance_min"), F.max("distance").alias("distance_max")))


def similarity_statistics(pairs: DataFrame, column: str = "similarity") -> DataFrame:
    """Mean, median, population deviation, bounds, and counts of high (>= 0.7), medium and low (< 0.3) similarities."""
    c = F.col(column)
    return pairs.agg(F.count("*").alias("pairs"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c >= 0.7).alias("high"), F.count_if((c >= 0.3) & (c < 0.7)).alias("medium"), F.count_if(c < 0.3).alias("low"))


def match_statistics(matches: DataFrame, nodes1: DataFrame, nodes2: DataFrame, distance: str = "distance") -> DataFrame:
    n1, n2 = nodes1.agg(F.count("*").alias("n1")), nodes2.agg(F.count("*").alias("n2"))
    m = matches.agg(F.countDistinct("g1_id").alias("m1"), F.countDistinct("g2_id").alias("m2"), F.avg(distance).alias("distance_mean"), F.percentile(distance, F.lit(0.5)).alias("distance_median"), F.max(distance).alias("distance_max"))
    return m.crossJoin(n1).crossJoin(n2).select(F.col("m1").alias("matched_g1"), F.col("m2").alias("matched_g2"), (100.0 * F.col("m1") / F.col("n1")).alias("coverage_g1"), (100.0 * F.col("m2") / F.col("n2")).alias("coverage_g2"), "distance_mean", "distance_median", "distance_max")
