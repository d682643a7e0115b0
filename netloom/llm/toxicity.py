"""Toxicity by non-negative positive-unlabelled learning.

A linear model on hashed words and word beginnings is fitted with numpy to confirmed toxic texts and unlabelled ones. With pi the share of toxic texts, the risk
is pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): the unlabelled risk less what the toxic texts among them contribute, never below zero. When that
part falls below zero on a step, the step climbs it instead, as the non-negative estimator prescribes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Store, small
from .textbytes import BASE, LOWER, SPACE, prefix_sums, slabs, span_hash

#: Texts that the model is fitted on, at most: toxic ones, and unlabelled ones. Each is the first so many in the order of a hash of the id.
TOXIC_ROWS, UNLABELLED_ROWS = 6_000, 18_000
BITS = 18
#: Bytes of a word's beginning that is a feature of its own.
BEGINNINGS = (4, 5)
_WORD = ~SPACE
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _WORD[_c] = False


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, sorted within it, and how many each has: words in lower case, and the beginnings of longer words."""
    rows = len(off) - 1
    if not len(buf):
        return np.empty(0, np.int64), np.zeros(rows, np.int64)
    low = LOWER[buf]
    solid = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(off, starts, "right") - 1
    sums = prefix_sums(low, BASE)
    found = [span_hash(sums, starts, ends, BASE)]
    owner = [of]
    for k in BEGINNINGS:
        far = np.flatnonzero(ends - starts > k)
        found.append(span_hash(sums, starts[far], starts[far] + k, BASE) ^ np.uint64(0x9E3779B97F4A7C15 + k))
        owner.append(of[far])
    number = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((np.concatenate(owner) << BITS) | number)
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=rows)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, off in slabs(batch.column(1)):
            numbers, counts = features(buf, off)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.astype(np.int32)))], names=["toxic", "f"])


class Rows:
    """A sparse 0/1 matrix by rows: feature numbers one row after the other, and how many each row has."""

    def __init__(self, lists: pa.Array):
        self.index = np.asarray(lists.flatten()).astype(np.int64)
        self.counts = np.asarray(lists.value_lengths()).astype(np.int64)

    def __len__(self) -> int:
        return len(self.counts)


#: Standard errors by which a feature's share of toxic and of unlabelled texts must differ, and texts that must have it: parameters of the model.
LEAST_Z, LEAST_TEXTS = 4.0, 5


def telling(p: np.ndarray, u: np.ndarray, n: int, m: int) -> np.ndarray:
    """Features whose share of texts differs between the n toxic and the m unlabelled ones by more than chance would have it; p and u count them."""
    q = (p + u) / (n + m)
    z = (p / n - u / m) / np.sqrt(np.maximum(q * (1 - q) * (1 / n + 1 / m), 1e-12))
    return np.flatnonzero((np.abs(z) >= LEAST_Z) & (p + u >= LEAST_TEXTS))


def fit(positive: Rows, unlabelled: Rows, chosen: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 0.3) -> np.ndarray:
    """Weights of the chosen features, the bias last, by Adam on the non-negative risk with the logistic loss over all rows at once.

    decay pulls weights to 0 and is shared among the toxic texts, so that the more there are, the less it pulls.
    """
    size = 1 << BITS
    number = np.full(size, -1)
    number[chosen] = np.arange(len(chosen))

    def cells(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        f, at = number[rows.index], np.repeat(np.arange(len(rows)), rows.counts)
        return f[f >= 0], at[f >= 0]

    (pf, pr), (uf, ur) = cells(positive), cells(unlabelled)
    n, m, k = len(positive), len(unlabelled), len(chosen)
    w, mean, square = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        zp, zu = np.bincount(pr, w[pf], minlength=n) + w[-1], np.bincount(ur, w[uf], minlength=m) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = prior * (sp - 1) / n - prior * sp / n, su / m
        else:  # climb the negative part back to zero
            gp, gu = prior * sp / n, -su / m
        g = np.bincount(np.concatenate([pf, uf]), np.concatenate([gp[pr], gu[ur]]), minlength=k + 1).astype(float)  # of no cells, counts are integers
        g[:-1] += decay / n * w[:-1]
        g[-1] = gp.sum() + gu.sum()
        mean += 0.1 * (g - mean)
        square += 0.001 * (g * g - square)
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(size + 1)
    out[chosen], out[-1] = w[:-1], w[-1]
    return out


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, store: Store, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> np.ndarray | None:
    """Weights from at most so many toxic and unlabelled texts; None without a toxic one or without another label.

    Labels of held-out rows are not read. The unlabelled texts are any documents that are not held out, labelled or not. Null texts are empty; rows
    that repeat an id are each a text; labels that repeat one count as toxic if any does.
    """
    learn = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    learn = learn.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    # the share of toxic texts is taken over all labels; the texts are those that a hash of the id puts first
    counted = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    total, toxic = sum(counted.values()), counted.get(1, 0)
    if not toxic or total == toxic:
        return None
    order = F.xxhash64("id")
    # the unlabelled texts are any, toxic ones among them: their labels are not looked at
    toxic_ones = learn.where("toxic = 1").orderBy(order, "id").limit(toxic_rows)
    every = docs.select(F.col("doc_id").cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out("id"))
    unlabelled = every.distinct().orderBy(order, "id").limit(unlabelled_rows).select("id", F.lit(0).alias("toxic"))
    chosen = store.cut(toxic_ones.unionByName(unlabelled), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    picked = texts.join(small(chosen, toxic_rows + unlabelled_rows), "id").select("toxic", "t")
    found = store.cut(picked.mapInArrow(_featurise, "toxic int, f array<int>"), "features")
    n, m = (found.where(F.col("toxic") == k).count() for k in (1, 0))
    if not n or not m:
        return None
    # the driver sees how many texts have each of the 2**BITS features, and then of each text the few that tell
    counts = found.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("u")).toArrow()
    p, u = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = np.asarray(counts["f"])
    p[at], u[at] = np.asarray(counts["p"]), np.asarray(counts["u"])
    chosen = telling(p, u, n, m)
    wanted = F.lit(chosen.tolist()).cast("array<int>") if len(chosen) else F.array().cast("array<int>")
    few = found.select("toxic", F.array_intersect("f", wanted).alias("f")).toArrow().combine_chunks()
    is_toxic = np.asarray(few["toxic"]) == 1
    rows = [Rows(pa.concat_arrays(few["f"].filter(pa.array(k)).chunks)) for k in (is_toxic, ~is_toxic)]
    return fit(*rows, chosen, toxic / total)


def scores(docs: DataFrame, weights: np.ndarray | None) -> Column:
    """A column for the score (0 to 1) of the column text of docs; null text is empty. Without weights every score is 0."""
    if weights is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS + 1 floats

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, z = shared.value, np.zeros(len(texts))
        for row, buf, off in slabs(texts):
            numbers, counts = features(buf, off)
            z[row : row + len(counts)] = np.bincount(np.repeat(np.arange(len(counts)), counts), w[numbers], minlength=len(counts)) + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return score(F.coalesce(F.col("text").cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, held_out, score, predicted), a row per input row.

    Labels are learned only where crc32(doc_id as text) mod 5 is not 0. Scores depend on the text alone: null text is empty and scored as such; rows
    that repeat are each scored; a row without an id is not held out. Without both kinds of labels every score is 0. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = rows.select("doc_id", scores(rows, train(docs, labels, store)).alias("score"))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, store: Store) -> DataFrame:
    """docs whose score is below one half, so that predicted is 0; the columns stay as they are. Null texts are scored as empty; rows that repeat go or stay together."""
    return docs.where(scores(docs, train(docs, labels, store)) < 0.5)
