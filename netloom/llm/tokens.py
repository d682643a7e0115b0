"""Token counts by heap-and-linked-list byte-pair merging: no identifier is ever made."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import ByteLevel
from .textbytes import slabs

#: Words whose counts a Python worker remembers; when full it starts anew. Any size gives the same counts.
REMEMBERED = 1_000_000
SLAB = 2 << 20


def count_tokens(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of word when the adjacent pair of lowest rank, leftmost first, is merged until none is left: symbols less merges."""
    n = len(word)
    if n < 2:
        return n
    symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_of = ranks.get
    heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank_of((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = a + b, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((a + b, symbol[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbol[k]))
        if (h := before[i]) >= 0 and (r := rank_of((symbol[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbol[h], a + b))
    return n - merges


class _Counter:
    def __init__(self, path: str):
        self.model = ByteLevel(path)
        self.ranks = self.model.ranks()
        self.known: dict[int, int] = {}

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        known = self.known
        for row, buf, off in slabs(texts, SLAB):
            keys, starts, ends, special, index, rows = self.model.words(buf, off)
            each = [known.get(k, -1) for k in keys.tolist()]
            fresh = [i for i, c in enumerate(each) if c < 0]
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
            raw = buf.tobytes()
            for i in fresh:
                each[i] = known[int(keys[i])] = 1 if special[i] >= 0 else count_tokens(raw[starts[i] : ends[i]], self.ranks)
            if len(index):
                found = np.bincount(rows, np.array(each, np.float64)[index], minlength=len(off) - 1)
                out[row : row + len(off) - 1] = found.astype(np.int64)
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_bytes, n_tokens, over_limit), a row per input row, counted over the whole text.

    n_tokens is what the library gives for the byte-level BPE file at path without added special tokens; a special string inside a text is one
    token. Null and empty texts have 0 bytes and 0 tokens; repeated rows and rows without an id are each counted; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter.counts(batch.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
