"""Substring dedup: every byte of a string of LENGTH bytes that occurs anywhere else is removed.

Occurrences of one string are brought together by an anchor that depends on the string alone: of its K-byte pieces the one of least hash. A
document falls into runs of window starts with the same anchor; runs whose anchor occurs once hold nothing repeated. Runs that are equal as a
whole elsewhere are repeated as a whole. What is left, the runs at the borders of repeated passages, is settled byte by byte with a suffix array
over the runs' left contexts, each ended by the rank of its right context.

The suffix array is built by linear grouping: suffixes are refined into groups of equal Lyndon prefix, from the highest group down, by pointers to
the previous smaller suffix; a second pass emits the order within the groups. No renaming, no recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Store, id_key
from .textbytes import BASE, BASE_2, inverse_powers, mix, powers, slabs

LENGTH, K = 200, 48
#: Anchors with more distinct runs are settled by digests of their windows, counted on all executors, instead of in one task.
HOT_RUNS = 4096
#: Bytes of a document that are worked on at once; the windows of a longer one are taken in turns.
PIECE = 4 << 20
#: Bytes of runs that one task sorts, about, and symbols of one suffix array.
TASK_BYTES = 2 << 20
ARRAY_SYMBOLS = 1 << 18


#: A text's key: its doc_id and a hash of it, so that rows that repeat a doc_id with another text have decisions of their own.
_KEY = "struct<doc:long,th:long>"


def _key() -> Column:
    return F.struct(id_key().alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("th")).alias("id")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of text in order. The last symbol must be smaller than all others and occur once."""
    n = len(text)
    _, symbol = np.unique(text, return_inverse=True)
    group = symbol.tolist()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(symbol))]).tolist()
    by_symbol = np.argsort(symbol, kind="stable").tolist()
    members = [by_symbol[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    size = [len(m) for m in members]
    k = len(members)
    above, below = list(range(1, k + 1)), list(range(-1, k - 1))
    above[-1] = -1
    high = [False] * k  # groups from the current one up
    smaller = [-1] * n  # the previous suffix of a lower group
    g = k - 1
    while g >= 0:
        high[g] = True
        if size[g]:
            counts: dict[int, int] = {}
            for i in members[g]:  # ascending, so that pointers within the group exist already
                if group[i] == g:
                    j = i - 1
                    while j >= 0 and high[group[j]]:
                        j = smaller[j]
                    smaller[i] = j
                    if j >= 0:
                        counts[j] = counts.get(j, 0) + 1
            if counts:
                parts: dict[tuple[int, int], list[int]] = {}
                for j, c in counts.items():
                    old = group[j]
                    if size[old] > 1:
                        parts.setdefault((c, old), []).append(j)
                # suffixes with more pointers go further up; each set becomes a group directly above its old one
                for c, old in sorted(parts, reverse=True) if len(parts) > 1 else parts:
                    moved = parts[c, old]
                    if len(moved) == size[old]:
                        continue  # the whole of what is left of the group: it stays where it is
                    new = len(size)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    high.append(False)
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for j in moved:
                        group[j] = new
        g = below[g]
    start, at, g = [0] * len(size), 0, 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return np.array(out, np.int64)


def anchors(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of the documents in buf: row, first window, number of windows, anchor's distance from the first window, anchor hash, digest of all."""
    nothing = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    n, w = len(buf), length - k + 1
    if n < length:
        return nothing
    raw = buf.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(raw * powers(BASE, n), out=sums[1:])
    m = n - k + 1
    hashes = mix((sums[k:] - sums[:m]) * inverse_powers(BASE, m))
    # the leftmost of the least hashes in each window: places are the low bits
    low = np.uint64((1 << 24) - 1)
    value = (hashes & ~low) | np.arange(m, dtype=np.uint64)
    pad = np.concatenate([value, np.full(-m % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = m - w + 1
    least = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
    starts = np.arange(windows)
    row = np.searchsorted(off, starts, "right") - 1
    valid = starts + length <= off[row + 1]
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return nothing
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    count = np.flatnonzero(ends) + 1 - first
    anchor = (least[first] & low).astype(np.int64)
    np.cumsum(raw * powers(BASE_2, n), out=sums[1:])
    stop = first + count + length - 1
    digest = mix((sums[stop] - sums[first]) * inverse_powers(BASE_2, n)[first] + (count * 512 + anchor - first).astype(np.uint64))
    return row[first], first, count, anchor - first, hashes[anchor], digest


def _pieces(text: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the bytes in the document, bytes, offsets): the windows of a very long document come in turns."""
    for row, buf, off in slabs(text):
        if len(buf) <= PIECE:
            yield row, 0, buf, off
        else:
            for at in range(0, len(buf) - length + 1, PIECE):
                part = buf[at : at + PIECE + length - 1]
                yield row, at, part, np.array([0, len(part)])


def _list_runs(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, buf, off in _pieces(batch.column(1), length):
                of, first, count, left, owner, digest = anchors(buf, off, length, k)
                for a in range(0, len(of), 50_000):
                    s = slice(a, a + 50_000)
                    ids = batch.column(0).take(pa.array(of[s] + row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(first[s] - off[of[s]] + at), pa.array((left[s] * 256 + count[s]).astype(np.int32)), pa.array(owner[s].view(np.int64)), pa.array(digest[s].view(np.int64))], names=["id", "start", "shape", "owner", "digest"])

    return run


def _fetch_runs(length: int):
    """The bytes of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, off in slabs(batch.column(1)):
                wanted = batch.column(2).slice(row, len(off) - 1)
                owner = np.repeat(np.arange(len(wanted)), np.asarray(wanted.value_lengths()))
                flat = wanted.flatten()
                start, shape = np.asarray(flat.field("start")), np.asarray(flat.field("shape"))
                begin = off[owner] + start
                raw = buf.tobytes()
                ids = batch.column(0).slice(row, len(wanted)).take(pa.array(owner))
                for a in range(0, len(owner), 5_000):
                    s = slice(a, a + 5_000)
                    data = [raw[x : x + (c & 255) + length - 1] for x, c in zip(begin[s].tolist(), shape[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, 5_000), pa.array(start[s]), pa.array(shape[s]), flat.field("owner").slice(a, 5_000), pa.array(data, pa.binary())], names=["id", "start", "shape", "owner", "data"])

    return run


def repeated_windows(owner: np.ndarray, left: np.ndarray, count: np.ndarray, data: list[bytes], length: int, k: int) -> list[np.ndarray]:
    """For each run, which of its windows occur in another of these runs. Runs of one anchor must all be among them."""
    n = len(data)
    wide = length - k
    # right contexts in order, and how much each shares with the one before
    right = np.zeros((n, wide), np.int16)
    for i, d in enumerate(data):
        tail = np.frombuffer(d, np.uint8)[left[i] + k :]
        right[i, : len(tail)] = tail
        right[i, : len(tail)] += 1
    as_keys = np.ascontiguousarray(right.astype(">i2")).view(f"V{2 * wide}").ravel()
    order = np.lexsort((np.argsort(np.argsort(as_keys, kind="stable"), kind="stable"), owner))
    sorted_right = right[order]
    equal = sorted_right[1:] == sorted_right[:-1]
    equal &= sorted_right[1:] > 0
    shared = np.where(equal.all(1), wide, np.argmin(equal, axis=1))
    same = owner[order][1:] == owner[order][:-1]
    shared = np.where(same, shared, -1)
    identical = same & (sorted_right[1:] == sorted_right[:-1]).all(1)
    rank_sorted = np.concatenate([[0], np.cumsum(~identical)])
    rank = np.empty(n, np.int64)
    rank[order] = rank_sorted
    step = np.full(rank_sorted[-1] + 1, -1, np.int64)  # what a rank shares with the one below
    step[rank_sorted[1:][~identical]] = shared[~identical]
    # the text: left contexts, each ended by its rank; then the least symbol
    lengths = left + 1
    begin = np.cumsum(lengths) - lengths
    text = np.zeros(int(lengths.sum()) + 1, np.int64)
    ahead = np.zeros(len(text), np.int64)  # symbols up to the rank
    of = np.repeat(np.arange(n), lengths)
    ahead[:-1] = left[of] - (np.arange(len(of)) - begin[of])
    text[:-1] = np.frombuffer(b"".join(d[:x] + b"\0" for d, x in zip(data, left.tolist(), strict=True)), np.uint8).astype(np.int64) + 1
    text[begin + left] = 257 + rank
    sa = suffix_array(text)[1:]
    a, b = sa[:-1], sa[1:]
    # neighbours count if the same bytes lead to the same anchor
    alive = np.flatnonzero(ahead[a] == ahead[b])
    for t in range(int(left.max(initial=0))):
        far = ahead[a[alive]] > t
        ok = ~far | (text[np.minimum(a[alive] + t, len(text) - 1)] == text[np.minimum(b[alive] + t, len(text) - 1)])
        alive = alive[ok]
    reach = np.full(len(a), -1, np.int64)  # bytes shared after the anchor
    if len(alive):
        lo, hi = rank[of[a[alive]]], rank[of[b[alive]]]
        reach[alive] = _range_least(step, lo + 1, hi, wide)
    need = length - k - ahead[:-1]  # after the anchor, for a window that starts here
    best = np.full(len(text), -1, np.int64)
    np.maximum.at(best, a, reach)
    np.maximum.at(best, b, reach)
    hit = (best[:-1] >= need) & (best[:-1] >= 0)
    place = np.arange(len(of)) - begin[of]
    hit &= place < count[of]
    return [hit[s : s + c] for s, c in zip(begin.tolist(), count.tolist(), strict=True)]


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, empty: int) -> np.ndarray:
    """The least of values[lo..hi] of each pair; where lo > hi, empty."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        w = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    n = hi - lo + 1
    out = np.full(len(lo), empty, np.int64)
    some = n > 0
    level = np.zeros(len(lo), np.int64)
    level[some] = np.floor(np.log2(n[some])).astype(np.int64)
    for t in range(len(table)):
        at = np.flatnonzero(some & (level == t))
        if len(at):
            out[at] = np.minimum(table[t][lo[at]], table[t][hi[at] - (1 << t) + 1])
    return out


def _spans(ids: pa.Array, start: np.ndarray, hits: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    rows, first, last = [], [], []
    for i, hit in enumerate(hits):
        if hit.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for s, e in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                rows.append(i)
                first.append(int(start[i]) + s)
                last.append(int(start[i]) + e - 1 + length)
    if rows:
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["id", "s", "e"])


def _sort_runs(length: int, k: int):
    """Settles the runs of a task: whole anchors at a time, so many that a suffix array has about ARRAY_SYMBOLS symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # TASK_BYTES, and at most HOT_RUNS runs more
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        whole = whole.take(pa.array(np.argsort(whole["owner"].to_numpy(), kind="stable")))
        owner, shape, start = whole["owner"].to_numpy(), whole["shape"].to_numpy().astype(np.int64), whole["start"].to_numpy()
        left, count = shape >> 8, shape & 255
        data = whole["data"].to_pylist()
        ids = whole["id"].combine_chunks()
        ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)).tolist()
        a, symbols, last = 0, 0, 0
        for e in ends:
            symbols += int((left[last:e] + 1).sum())
            last = e
            if symbols >= ARRAY_SYMBOLS or e == len(owner):
                hits = repeated_windows(owner[a:e], left[a:e], count[a:e], data[a:e], length, k)
                yield from _spans(ids.slice(a, e - a), start[a:e], hits, length)
                a, symbols = e, 0

    return run


def _digest_windows(length: int):
    """Two digests of every window of the runs of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                d = np.frombuffer(batch.column(4)[i].as_py(), np.uint8)
                n = len(d) - length + 1
                out = []
                for base in (BASE, BASE_2):
                    sums = np.zeros(len(d) + 1, np.uint64)
                    np.cumsum((d.astype(np.uint64) + np.uint64(1)) * powers(base, len(d)), out=sums[1:])
                    out.append(mix((sums[length:] - sums[:n]) * inverse_powers(base, n)).view(np.int64))
                same = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), pa.array(batch.column(1)[i].as_py() + np.arange(n)), pa.array(out[0]), pa.array(out[1])], names=["id", "s", "d1", "d2"])

    return run


def repeated_spans(docs: DataFrame, store: Store, length: int = LENGTH, k: int = K, hot_runs: int = HOT_RUNS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) to (id, spans): for each document the byte ranges [s, e) that repeated strings cover; ranges may overlap.

    A string of length bytes counts wherever it starts twice, in one document or in two; rows that repeat are documents of their own, whose spans are
    listed once for their id and text, as are those of rows without an id by their text. Null text is empty. Other columns are ignored.
    """
    texts = docs.select(_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    runs = store.cut(texts.mapInArrow(_list_runs(length, k), f"id {_KEY}, start long, shape int, owner long, digest long"), "runs")
    often = store.cut(runs.groupBy("owner").agg(F.count("*").alias("m")).where("m > 1").select("owner"), "often")
    shared = store.cut(runs.join(often, "owner", "left_semi"), "shared")
    store.free("runs", "often")
    kinds = store.cut(shared.groupBy("owner", "digest").agg(F.count("*").alias("m"), F.min(F.struct("id", "start", "shape")).alias("at")), "kinds")
    whole = shared.join(kinds.where("m > 1").select("owner", "digest"), ["owner", "digest"], "left_semi")
    whole = store.cut(whole.select("id", F.col("start").alias("s"), (F.col("start") + F.col("shape").bitwiseAND(255) - 1 + length).alias("e")), "whole")
    store.free("shared")
    mixed = kinds.groupBy("owner").agg(F.count("*").alias("kinds"), F.min("m").alias("least")).where("kinds > 1 and least = 1").select("owner", "kinds")
    open_ = store.cut(kinds.join(mixed, "owner").select("owner", "at.*", "kinds"), "open")
    store.free("kinds")
    wanted = store.cut(open_.groupBy("id").agg(F.collect_list(F.struct("start", "shape", "owner")).alias("wanted")), "wanted")
    fetched = texts.join(wanted, "id").select("id", "t", "wanted").mapInArrow(_fetch_runs(length), f"id {_KEY}, start long, shape int, owner long, data binary")
    hot = open_.where(F.col("kinds") > hot_runs).select("owner").distinct()
    fetched = store.cut(fetched, "fetched")  # a repeated row brings its runs twice, all of which are repeated as a whole already
    any_hot = hot.limit(1).count() > 0
    hot = store.cut(hot, "hot") if any_hot else None
    cold = fetched.join(hot, "owner", "left_anti") if any_hot else fetched
    size = cold.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = cold.repartition(max(1, -(-size // task_bytes)), "owner").mapInArrow(_sort_runs(length, k), f"id {_KEY}, s long, e long")
    spans = whole.unionByName(store.cut(parts, "sorted"))
    if any_hot:
        windows = store.cut(fetched.join(hot, "owner", "left_semi").select("id", "start", "shape", "owner", "data").mapInArrow(_digest_windows(length), f"id {_KEY}, s long, d1 long, d2 long"), "windows")
        again = windows.groupBy("d1", "d2").agg(F.count("*").alias("m")).where("m > 1").select("d1", "d2")
        covered = windows.join(again, ["d1", "d2"], "left_semi").select("id", "s", (F.col("s") + length).alias("e"))
        spans = spans.unionByName(store.cut(covered, "covered"))
    return spans.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes that ranges (s, e) cover."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], reach[np.append(at[1:] - 1, len(spans) - 1)]], 1)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        lists = batch.column(2)
        kept, removed, runs, size = [], [], [], []
        for i in range(len(batch)):
            raw = texts[i].as_py()
            size.append(len(raw))
            if lists[i].is_valid:
                flat = lists[i].values
                m = merged(np.stack([np.asarray(flat.field("s")), np.asarray(flat.field("e"))], 1))
                edge = [0, *m.ravel().tolist(), len(raw)]
                raw = b"".join(raw[a:b] for a, b in zip(edge[0::2], edge[1::2], strict=True))
                runs.append(len(m))
            else:
                runs.append(0)
            removed.append(size[-1] - len(raw))
            kept.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeated_strings(docs: DataFrame, store: Store, **how) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_bytes, n_removed, n_spans, kept): kept holds the bytes that stay, a row per input row.

    Strings are judged on the input, not on what is left. Bytes may be cut within a character, so kept is binary.
    """
    spans = store.cut(repeated_spans(docs, store, **how), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    joined = rows.join(spans, "id", "left").select("doc_id", "t", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
