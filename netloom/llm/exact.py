"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is the value of its bytes as a polynomial at four points, modulo 2**31-1. Chunks are hashed on their own and combine by
shifting with the power of the length that follows, so a text of any size is hashed in parallel pieces: very long texts are first cut into
segments, whose fingerprints a grouped sum puts together. Texts of equal fingerprint and length are then compared chunk by chunk; the
aggregation streams the chunks and combines equal ones before the shuffle, so a group of copies is never gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Store, id_key, small
from .textbytes import slabs

PRIME = 2**31 - 1
#: Points at which the polynomial is taken: fixed values below PRIME.
POINTS = (1_000_003, 461_845_907, 1_540_483_477, 2_026_538_771)
#: Bytes of one chunk: 255 * PRIME * CHUNK stays below 2**53, so the dot products are exact in double precision.
CHUNK = 4096
#: Characters from which a text is cut into segments that tasks hash on their own.
SEGMENT = 1 << 22
#: Characters of one piece in the final comparison.
COMPARE = 1 << 16


def _power(x: int, n: int) -> int:
    return pow(x, n, PRIME)


_TABLE = np.array([[_power(x, CHUNK - 1 - i) for x in POINTS] for i in range(CHUNK)], np.float64)
_STEP = np.array([_power(x, CHUNK) for x in POINTS], np.int64)


def fingerprint(data: np.ndarray) -> np.ndarray:
    """The polynomial of these bytes at each point; chunk hashes combine pairwise, each left one shifted by the length to its right."""
    n = -(-max(len(data), 1) // CHUNK)
    padded = np.zeros(n * CHUNK, np.float64)  # leading zeros leave the value as it is
    if len(data):
        padded[-len(data) :] = data
    h = (padded.reshape(n, CHUNK) @ _TABLE).astype(np.int64) % PRIME
    step = _STEP
    while len(h) > 1:
        if len(h) % 2:
            h = np.concatenate([np.zeros((1, len(POINTS)), np.int64), h])
        h = (h[0::2] * step + h[1::2]) % PRIME
        step = step * step % PRIME
    return h[0]


def combine(left: np.ndarray, right: np.ndarray, right_bytes: int) -> np.ndarray:
    """The fingerprint of two texts put one after the other."""
    shift = np.array([_power(x, right_bytes) for x in POINTS], np.int64)
    return (left * shift + right) % PRIME


def _hash_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's share of its document's fingerprint: shifted by the bytes that follow it there."""
    for batch in batches:
        after = batch.column(2).to_numpy(zero_copy_only=False)
        shares = np.empty((len(batch), len(POINTS)), np.int64)
        for row, buf, off in slabs(batch.column(1)):
            for i in range(len(off) - 1):
                h = fingerprint(buf[off[i] : off[i + 1]])
                shares[row + i] = combine(h, 0, int(after[row + i])) if after[row + i] else h
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(shares[:, k]) for k in range(len(POINTS))), batch.column(3)], names=["key", "f0", "f1", "f2", "f3", "sha"])


def normalised(text: str = "text"):
    """Text with every run of 0x20 and 0x09-0x0D as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, store: Store, prime_bits: int = 31, segment: int = SEGMENT) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, keep_id, group_size, kept, text_sha256), a row per input row.

    Texts are equal if identical after normalised(). Null text counts as empty; empty texts equal each other. Of equal texts the row with the
    smallest doc_id stays (rows without an id come last); of rows that repeat both id and text each is kept, since they share keep_id.
    Other columns, whatever their names, are ignored. An empty table gives an empty result. prime_bits below 31 keeps only so many bits of
    each fingerprint word: for tests of colliding fingerprints.
    """
    mask = (1 << prime_bits) - 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("t"))
    # most texts are one piece; a very long one becomes several, each knowing the bytes that follow it
    pieces = texts.select("doc_id", "t", F.sha2("t", 256).alias("sha"), F.octet_length("t").cast("long").alias("n"), F.greatest(F.lit(1), F.ceil(F.length("t") / segment)).cast("int").alias("of"))
    pieces = pieces.select("doc_id", "t", "sha", "n", "of", F.explode(F.sequence(F.lit(1), F.col("of"))).alias("k"))
    part = F.when(F.col("of") == 1, F.col("t")).otherwise(F.col("t").substr((F.col("k") - 1) * segment + 1, F.lit(segment)))
    after = F.when(F.col("of") == 1, F.lit(0)).otherwise(F.col("n") - F.octet_length(F.col("t").substr(F.lit(1), F.col("k") * segment)))
    shares = pieces.select("doc_id", part.alias("part"), after.cast("long").alias("after"), F.concat_ws(":", "sha", "n", "of", "k").alias("s"))
    shares = store.cut(shares.mapInArrow(_hash_segments, "doc_id long, f0 long, f1 long, f2 long, f3 long, s string"), "shares")
    of = F.split("s", ":")
    words = [f"f{i}" for i in range(len(POINTS))]
    shares = shares.select("doc_id", *words, of[0].alias("sha"), of[1].cast("long").alias("n"), of[2].cast("int").alias("of"), of[3].cast("int").alias("k"))
    # a row that repeats id and text repeats every piece: pieces are summed once, and the result stands for so many rows
    once = shares.where("of > 1").groupBy("doc_id", "sha", "n", "k", *words).count()
    summed = once.groupBy("doc_id", "sha", "n", "count").agg(*[(F.sum(w) % PRIME).alias(w) for w in words])
    summed = summed.select("doc_id", *words, "sha", "n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("col")
    prints = shares.where("of = 1").select("doc_id", *words, "sha", "n").unionByName(summed)
    prints = prints.withColumns({w: F.col(w).bitwiseAND(mask) for w in words})

    key = ["f0", "f1", "f2", "f3", "n"]
    groups = store.cut(prints.groupBy(*key).agg(F.min(id_key()).alias("keep"), F.count("*").alias("size")).where("size > 1"), "groups")
    return _confirm(texts, prints, groups, store, key)


def _confirm(texts: DataFrame, prints: DataFrame, groups: DataFrame, store: Store, key: list[str]) -> DataFrame:
    """Chunkwise comparison of texts of equal fingerprint. Where two differ, their group is settled by the content itself."""
    members = prints.join(groups.select(*key), key, "left_semi").select(id_key().alias("id"), F.col("sha").alias("of"), *key).distinct()
    members = store.cut(members, "members")
    candidates = texts.select(id_key().alias("id"), "t").join(small(members.select("id", *key), 100_000), "id")
    pieces = candidates.select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("t") / COMPARE).cast("int")), lambda i: F.col("t").substr(i * COMPARE + 1, F.lit(COMPARE)))).alias("k", "part"))
    compared = pieces.groupBy(*key, "k").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    unequal = store.cut(compared.select(*key).distinct(), "unequal")
    same = prints.join(groups, key, "left")
    out = same.select("doc_id", F.coalesce("keep", id_key()).alias("keep"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), "sha", *key)
    if unequal.limit(1).count():
        # different texts share a fingerprint: for these alone the text decides
        clash = candidates.join(unequal, key, "left_semi").select("id", F.col("t"), F.sha2("t", 256).alias("sha"))
        rows = out.join(unequal, key, "left_semi").select("doc_id", "sha", *key)
        classes = rows.select(id_key().alias("id"), "sha").join(clash.dropDuplicates(["id", "sha"]), ["id", "sha"]).groupBy("t", "sha").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
        classes = classes.select("sha", "keep", "size")
        settled = rows.join(classes, "sha").select("doc_id", "keep", "size", "sha")
        out = out.join(unequal, key, "left_anti").select("doc_id", "keep", "size", "sha").unionByName(settled)
    keep = F.when(F.col("keep") < 2**63 - 1, F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
