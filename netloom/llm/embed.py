"""Near-duplicate embeddings: coarse inverted lists, residual product codes, table-lookup distances, exact cosine at the end.

No link is lost. Vectors are compared as unit vectors, where a cosine of t is a distance r = sqrt(2-2t). A vector is a member of the list of its
nearest centroid and probes every other list whose border is within r/2 of it: of two vectors within r of each other in different lists, one at
least lies within r/2 of the border between them. In a list, the table-lookup distance to a member's code errs by its residual at most, which is
kept with the code, so the filter lets every true pair through to the exact test in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, forest
from ..store import Store

#: Vectors that centroids and codebooks are fitted on: the first so many in the order of a hash of their id.
TRAIN_ROWS = 16_384
#: Most coarse lists.
MAX_LISTS = 4096
SUBSPACES, CODES = 16, 64
#: Members, and queries, of one block of a list; larger lists are dealt over several blocks.
BLOCK = 2048


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(half - x[i : i + 4096] @ centers.T, axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centers)
        counts = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centers, axis=0)


class Index:
    """Centroids and the codebooks of the residuals' subspaces."""

    def __init__(self, train: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.centers = kmeans(train, lists)
        rest = train - self.centers[_nearest(train, self.centers)]
        d = train.shape[1]
        self.bounds = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), codes) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
        self.apart = np.sqrt(np.maximum(((self.centers[:, None] - self.centers[None]) ** 2).sum(2), 1e-30)) if len(self.centers) <= 512 else None

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each decoded vector is from its own."""
        rest = x - self.centers[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        off = np.zeros(len(x))
        for m, (book, a, b) in enumerate(zip(self.books, self.bounds, self.bounds[1:], strict=False)):
            codes[:, m] = _nearest(rest[:, a:b], book)
            off += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(off)

    def border(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Distance of each x to the border between its home and every list (0 for home)."""
        square = ((self.centers**2).sum(1)[None] - 2 * x @ self.centers.T)
        own = square[np.arange(len(x)), home]
        if self.apart is not None:
            apart = self.apart[home]
        else:
            c = self.centers[home]
            apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (self.centers**2).sum(1)[None] - 2 * c @ self.centers.T, 1e-30))
        out = (square - own[:, None]) / (2 * apart)
        out[np.arange(len(x)), home] = 0
        return out

    def lookup(self, queries: np.ndarray, center: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to decoded members of one list, from a table of subspace distances for each query."""
        rest = queries - center
        out = np.zeros((len(queries), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.bounds, self.bounds[1:], strict=False)):
            table = ((rest[:, None, a:b] - book[None]) ** 2).sum(2)
            out += table[:, codes[:, m]]
        return np.sqrt(out)


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of a list column without nulls."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True)), x


def near_vectors(vectors: DataFrame, store: Store, cosine: float = 0.95, block: int = BLOCK, lists: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding, ...) to (vec_id, n_links, component_id, kept), a row per input row.

    Two vectors are linked if their cosine in double precision is >= cosine. Null and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths with each other. Equal vectors are one class, so a large group of copies is compared
    once. Rows that repeat a vec_id are vectors of their own that link as any others do. Rows without an id link too; they never name a component unless alone, when it is null. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    valid = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite).where(F.exists("v", lambda e: e != 0))
    classes = valid.groupBy("v").agg(F.count("*").alias("size"), F.min(F.coalesce("vec_id", F.lit(2**63 - 1))).alias("low"))
    # a class is named by a number of its own, since ids may repeat or be missing
    classes = store.cut(classes.withColumn("dim", F.size("v")), "classes-0")
    classes = store.cut(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    store.free("classes-0")
    links, edges = [], []
    for dim, count in [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()]:  # as many as there are vector lengths
        found = store.cut(_links(classes.where(F.col("dim") == dim), dim, count, cosine, block, lists, store), f"found-{dim}")
        links.append(found.where("a is null").select(F.col("b").alias("k"), "n"))
        edges.append(found.where("a is not null").select("a", "b"))
    spark = vectors.sparkSession
    counted = spark.createDataFrame([], "k long, n long")
    tied = spark.createDataFrame([], "a long, b long")
    for x in links:
        counted = counted.unionByName(x)
    for x in edges:
        tied = tied.unionByName(x)
    roots = components(tied, store, "components").select(F.col("node").alias("k"), "component")
    per_class = classes.join(counted.groupBy("k").agg(F.sum("n").alias("n")), "k", "left").join(roots, "k", "left")
    per_class = per_class.select("v", "low", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "k").alias("component"))
    names = per_class.groupBy("component").agg(F.min("low").alias("name"))
    named = per_class.join(names, "component").select("v", "n_links", "name")
    out = rows.join(named, "v", "left")
    name = F.when(F.col("name").isNull(), F.col("vec_id")).when(F.col("name") < 2**63 - 1, F.col("name"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))


def _links(classes: DataFrame, dim: int, count: int, cosine: float, block: int, lists: int | None, store: Store) -> DataFrame:
    """(a, b, n): with a null, b is linked to n vectors of other classes in one block; else a and b are in one component."""
    spark = classes.sparkSession
    sample = classes.select("v").orderBy(F.xxhash64("v"), "k").limit(TRAIN_ROWS).toArrow()["v"].combine_chunks()
    train, _ = _unit(sample)
    n_lists = lists or int(min(MAX_LISTS, max(1, count**0.5 / 2)))
    index = Index(train, n_lists)
    radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS + SUBSPACES * CODES vectors

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                x, _ = _unit(part.column(1))
                home = _nearest(x, index.centers)
                codes, off = index.encode(x, home)
                row, into = np.nonzero(index.border(x, home) <= radius / 2 + 1e-9)
                take = pa.array(row)
                arrays = [pa.array(into), pa.array(home[row]), *(part.column(c).take(take) for c in (0, 1, 2)), pa.array([c.tobytes() for c in codes]).take(take), pa.array(off[row])]
                yield pa.RecordBatch.from_arrays(arrays, names=["list", "home", "k", "v", "size", "code", "off"])

    dealt = store.cut(classes.select("k", "v", "size").mapInArrow(deal, "list long, home long, k long, v array<double>, size long, code binary, off double"), f"dealt-{dim}")
    # a list of many rows is dealt over blocks of members and blocks of queries; every pair of blocks is one group
    sizes = dealt.groupBy("list").agg(F.ceil(F.count_if(F.col("home") == F.col("list")) / block).cast("int").alias("mb"), F.ceil(F.count("*") / block).cast("int").alias("qb"))
    placed = dealt.join(F.broadcast(sizes.where("mb > 0")), "list")  # at most MAX_LISTS rows
    spot = F.xxhash64("k")
    member = placed.where("home = list").select("*", F.lit(True).alias("member"), F.pmod(spot, F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
    query = placed.select("*", F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(spot, F.col("qb")).cast("int").alias("q"))
    columns = ["list", "m", "q", "member", "home", "k", "v", "size", "code", "off"]

    def compare(table: pa.Table) -> pa.Table:
        index = shared.value
        table = table.combine_chunks()
        is_member = np.asarray(table["member"].combine_chunks())
        members, queries = table.filter(pa.array(is_member)), table.filter(pa.array(~is_member))
        nothing = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not len(members) or not len(queries):
            return nothing
        here = int(table["list"][0].as_py())
        mx, mv = _unit(members["v"].combine_chunks())
        qx, qv = _unit(queries["v"].combine_chunks())
        mk, qk = members["k"].to_numpy(), queries["k"].to_numpy()
        msize, qsize, qhome = members["size"].to_numpy(), queries["size"].to_numpy(), queries["home"].to_numpy()
        codes = np.frombuffer(b"".join(members["code"].to_pylist()), np.uint8).reshape(len(mk), -1)
        off = members["off"].to_numpy()
        mborder = index.border(mx, np.full(len(mx), here)) if (qhome != here).any() else None
        mnorm, qnorm = np.sqrt((mv * mv).sum(1)), np.sqrt((qv * qv).sum(1))
        for_query, for_member = np.zeros(len(qk), np.int64), np.zeros(len(mk), np.int64)
        tied: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(qk), 256):
            near = index.lookup(qx[at : at + 256], index.centers[here], codes) <= radius + off[None] + 1e-9
            i, j = np.nonzero(near)
            i += at
            exact = (qv[i] * mv[j]).sum(1) / (qnorm[i] * mnorm[j]) >= cosine
            i, j = i[exact], j[exact]
            # a pair is counted once: within a list by its smaller class, across lists in the smaller list that sees it
            same = qhome[i] == here
            once = same & (qk[i] < mk[j])
            if mborder is not None:
                both = mborder[j, qhome[i]] <= radius / 2 + 1e-9
                once |= ~same & (~both | (here < qhome[i]))
            i, j = i[once], j[once]
            np.add.at(for_query, i, msize[j])
            np.add.at(for_member, j, qsize[i])
            if len(i):
                tied.append(forest(qk[i], mk[j]))
        keys, n = np.concatenate([qk, mk]), np.concatenate([for_query, for_member])
        keys, n = keys[n > 0], n[n > 0]
        if not len(keys):
            return nothing
        a, b = forest(np.concatenate([t[0] for t in tied]), np.concatenate([t[1] for t in tied]))
        return pa.table({"a": pa.array([*[None] * len(keys), *a.tolist()], pa.int64()), "b": pa.array(np.concatenate([keys, b])), "n": pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))})

    blocks = member.select(*columns).unionByName(query.select(*columns))
    return blocks.groupBy("list", "m", "q").applyInArrow(compare, "a long, b long, n long")
