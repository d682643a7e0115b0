"""Near-duplicate documents by MinHash: bands find candidates, odd sketches sift them, full shingle sets decide.

Documents of equal shingle set are one class from the start. In each bucket of a band the members are compared with one leader, which differs
from band to band; then only members of components that still differ are compared with each other, so a bucket that already is one component
costs nothing and no bucket is ever paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, forest
from ..store import Store, id_key, small
from .textbytes import BASE, LOWER, mix, prefix_sums, slabs, span_hash, word_spans

#: Bands and rows: two sets of similarity 0.8 miss every band with probability (1 - 0.8**6)**48 < 1e-6.
BANDS, ROWS = 48, 6
#: Words of 64 bits of an odd sketch.
SKETCH_WORDS = 32
#: Candidates whose estimate is lower by this are not compared in full: over five standard deviations of the estimate at 0.8.
SLACK = 0.16
#: Comparisons left in a bucket beyond which they are made by blocks, and documents of a block.
CROWD, BLOCK = 256, 512


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and how many each has.

    A-Z count as a-z. A text with fewer words than width has all its words as one shingle; a text without words has none.
    """
    rows = len(off) - 1
    low = LOWER[buf]
    starts, ends, of = word_spans(low, off)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    word = span_hash(prefix_sums(low, BASE), starts, ends, BASE)
    per = np.bincount(of, minlength=rows)
    position = np.arange(len(of)) - (np.cumsum(per) - per)[of]
    size = np.minimum(per, width)[of]  # words of a shingle of this text
    head = position <= per[of] - size
    value = np.zeros(len(of), np.uint64)
    for k in range(width):
        reach = np.flatnonzero(head & (size > k))
        value[reach] = mix(value[reach] * np.uint64(0x2545F4914F6CDD1D) + word[reach + k] + np.uint64(k + 1))
    value, of = value[head], of[head]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.bincount(of[fresh], minlength=rows)


def signatures(sets: np.ndarray, counts: np.ndarray, bands: int, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of the non-empty sets."""
    begin = (np.cumsum(counts) - counts)[counts > 0]
    n = len(begin)
    k = bands * rows
    a, b = _constants(k, 1), _constants(k, 2)
    keys = np.zeros((n, bands), np.uint64)
    odd = np.zeros((n, words * 64), bool)
    at = np.arange(n)
    for i in range(k):
        low = np.minimum.reduceat((sets * a[i] + b[i]) >> np.uint64(16), begin)
        sample = mix(low + (np.uint64(i) << np.uint64(48)))
        keys[:, i // rows] = mix(keys[:, i // rows] + sample)
        odd[at, (sample % np.uint64(words * 64)).astype(np.int64)] ^= True  # parity: a second sample at the same place clears it
    keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
    return keys, np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * k).astype(np.int32)), pa.array(values.view(np.int64).ravel()))


def _sign(width: int, bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, off in slabs(batch.column(1)):
                sets, counts = shingle_sets(buf, off, width)
                n = len(counts)
                full = counts > 0
                keys, odd = np.zeros((n, bands), np.uint64), np.zeros((n, words), np.uint64)
                print_1, print_2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if full.any():
                    keys[full], odd[full] = signatures(sets, counts, bands, rows, words)
                    begin = (np.cumsum(counts) - counts)[full]
                    print_1[full] = np.add.reduceat(mix(sets), begin)
                    print_2[full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(counts), pa.array(print_1.view(np.int64)), pa.array(print_2.view(np.int64)), _lists(keys), _lists(odd)], names=["id", "n", "p1", "p2", "bands", "odd"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, off in slabs(batch.column(1)):
                sets, counts = shingle_sets(buf, off, width)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))], names=["id", "s"])

    return run


def near_duplicates(docs: DataFrame, store: Store, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, words: int = SKETCH_WORDS, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_shingles, component_id, kept), a row per input row.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the smallest doc_id reachable.
    Null texts and texts without words have no shingles and link with nothing, not even each other. Rows that repeat a doc_id are one node, whose
    set must be the same in each. Rows without an id link with nothing: their component_id is null and they are kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    signed = store.cut(texts.mapInArrow(_sign(width, bands, rows, words), "id long, n long, p1 long, p2 long, bands array<long>, odd array<long>"), "signed")
    linkable = signed.where("n > 0 and id is not null")
    sets_of = ["p1", "p2", "n"]
    classes = store.cut(linkable.groupBy(*sets_of).agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = linkable.join(classes.select(*sets_of, F.col("rep").alias("id")), [*sets_of, "id"], "left_semi").dropDuplicates(["id"])
    reps = store.cut(reps.select("id", "n", "bands", "odd"), "reps")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    # a leader for each bucket of two members at least, chosen by a hash so that bands have different leaders
    leaders = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), F.col("id").alias("leader"))).alias("l")).where("m > 1")
    members = store.cut(keyed.join(leaders.select("key", "l.leader"), "key"), "members")
    stars = members.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    stars = store.cut(_sift(stars, reps, percent, bands * rows, words), "stars")

    edges = spark.createDataFrame([], "a long, b long")
    labels = reps.select("id", F.col("id").alias("c"))
    # first the best leader of each document, then the other leaders where the components still differ, then the rest of the buckets
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", F.col("a"))).alias("a")).select("a", "b")
    wanted = store.cut(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted-0")
    sets = store.cut(texts.join(small(wanted), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, s array<long>"), "sets-0")
    for k in range(3):
        crowds = None
        if k == 0:
            pairs = best
        elif k == 1:
            pairs = _apart(stars.select("a", "b"), labels)
        else:
            few, crowds = _open_buckets(members.select("key", "id"), labels, store, crowd)
            pairs = store.cut(_sift(few, reps, percent, bands * rows, words), "across").select("a", "b")
            needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowds.select("id")).distinct()
            more = store.cut(needed.join(sets.select("id"), "id", "left_anti"), "wanted-2")
            if more.limit(1).count():
                sets = sets.unionByName(store.cut(texts.join(small(more), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, s array<long>"), "sets-2"))
        found = _confirm(pairs, sets, percent)
        if crowds is not None and crowds.limit(1).count():
            found = found.unionByName(_by_blocks(crowds, sets, percent, block))
        found = store.cut(found, f"links-{k}")
        if k and not found.limit(1).count():
            continue
        edges = edges.unionByName(found)
        roots = components(edges, store, f"components-{k}")
        labels = store.cut(reps.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c")), f"labels-{k}")
    named = classes.join(labels, F.col("rep") == F.col("id")).select(*sets_of, "c")
    out = signed.select("id", *sets_of).join(named, sets_of, "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("c"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _sift(pairs: DataFrame, reps: DataFrame, percent: int, samples: int, words: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose odd sketches do not speak against it, with the estimate."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    bits = words * 64
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    # z of n bits differ if some -n/2 ln(1 - 2z/n) samples do; a sample that differs puts two into the symmetric difference
    fraction = F.least(F.lit(2.0) * differ / bits, F.lit(0.9999))
    estimate = 1 - (-bits / 2.0 * F.log(1 - fraction)) / (2.0 * samples)
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", estimate.alias("estimate")).where(F.col("estimate") >= percent / 100 - SLACK)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    return pairs.join(a, "a").join(b, "b").where("ca <> cb").select("a", "b")


def _open_buckets(members: DataFrame, labels: DataFrame, store: Store, crowd: int) -> tuple[DataFrame, DataFrame]:
    """What is still to be compared in buckets of more than one component: pairs (a, b), and crowds (major, id, minor).

    The largest component of a bucket, its major one, needs no comparison within; each member of another one, a minor member, is to be compared with
    all of the bucket. Buckets with at most `crowd` such comparisons become pairs. In larger ones the minor members join a crowd around the
    major component, which is compared by blocks once for all its buckets: more is compared than the buckets ask, never less.
    """
    tagged = members.join(labels, "id")
    sizes = tagged.groupBy("key", "c").agg(F.count("*").alias("count"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("count", "c")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = mixed.select("key", F.col("top.c").alias("major"), ((F.col("all") - F.col("top.count")) * F.col("all") > crowd).alias("crowded"))
    open_ = store.cut(tagged.join(mixed, "key"), "open")
    minor = open_.where("c <> major and not crowded").select("key", F.col("id").alias("x"), F.col("c").alias("cx"))
    every = open_.where("not crowded").select("key", F.col("id").alias("y"), F.col("c").alias("cy"))
    pairs = minor.join(every, "key").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    crowds = open_.where("crowded").groupBy("major", "id").agg(F.max(F.col("c") != F.col("major")).alias("minor"))
    return pairs, store.cut(crowds, "crowds")


def _by_blocks(crowds: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of the minor members of each crowd with all of it. A task holds one block of each; it returns a spanning forest of its links."""
    sizes = crowds.groupBy("major").agg(F.ceil(F.count_if("minor") / block).cast("int").alias("nx"), F.ceil(F.count("*") / block).cast("int").alias("ny"))
    spot = F.xxhash64("id")
    dealt = crowds.join(sizes, "major").withColumns({"x": F.pmod(spot, F.col("nx")).cast("int"), "y": F.pmod(spot, F.col("ny")).cast("int")})
    xs = dealt.where("minor").select("major", "id", F.lit(True).alias("minor"), "x", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"))
    ys = dealt.select("major", "id", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"), "y")
    rows = xs.unionByName(ys).join(sets, "id").select("major", "x", "y", "minor", "id", "s")

    def compare(table: pa.Table) -> pa.Table:
        minor = np.asarray(table["minor"].combine_chunks())
        ids, lists = table["id"].to_numpy(), table["s"].combine_chunks()
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        flat, begin = np.asarray(lists.flatten()), np.cumsum(n) - n
        every = np.flatnonzero(~minor)
        at = np.repeat(np.arange(len(every)), n[every])
        values = np.concatenate([flat[begin[i] : begin[i] + n[i]] for i in every]) if len(every) else flat[:0]
        order = np.argsort(values, kind="stable")
        values, at = values[order], at[order]
        a, b = [], []
        for i in np.flatnonzero(minor).tolist():
            own = flat[begin[i] : begin[i] + n[i]]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            m = hi - lo
            hits = at[np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            both = np.bincount(hits, minlength=len(every))
            linked = np.flatnonzero(100 * both >= percent * (n[i] + n[every] - both))
            linked = linked[ids[every[linked]] != ids[i]]
            a.append(np.full(len(linked), ids[i]))
            b.append(ids[every[linked]])
        a, b = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (a, b))
        a, b = forest(a, b) if len(a) else (a, b)
        return pa.table({"a": a, "b": b})

    return rows.groupBy("major", "x", "y").applyInArrow(compare, "a long, b long")


def deduplicated(docs: DataFrame, store: Store, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are linked, directly or through others, to one of smaller doc_id; the columns stay as they are."""
    gone = near_duplicates(docs, store, width, percent).where("not kept").select(F.col("doc_id").alias("gone"))
    gone = store.cut(gone.distinct(), "gone")
    return docs.join(small(gone), docs["doc_id"].cast("long") == gone["gone"], "left_anti")
