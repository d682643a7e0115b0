"""Packing documents into fixed-size sequences: hierarchical residual best-fit.

Documents become pieces of at most one sequence. Each task packs its own pieces best-fit, largest first, and lets go of the bins that are
nearly full. The others travel on as single items into fewer tasks, where best-fit joins them, and so on up the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import ByteLevel
from ..store import Store
from .textbytes import slabs

#: Items that one task packs at a time.
TASK_ITEMS = 100_000
#: Words whose ids a Python worker remembers; when full it starts anew.
REMEMBERED = 400_000
SLAB = 2 << 20


class _Encoder:
    def __init__(self, path: str):
        self.model = ByteLevel(path)
        self.bpe = self.model.library.model
        self.known: dict[int, bytes] = {}

    def ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        keys, starts, ends, special, index, rows = self.model.words(buf, off)
        if not len(index):
            return np.empty(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        known = self.known
        each = [known.get(k) for k in keys.tolist()]
        fresh = [i for i, x in enumerate(each) if x is None]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
        raw = buf.tobytes()
        for i in fresh:
            ids = [special[i]] if special[i] >= 0 else [t.id for t in self.bpe.tokenize(self.model.letters(raw[starts[i] : ends[i]]))]
            each[i] = known[int(keys[i])] = np.array(ids, np.uint32).tobytes()
        flat = np.frombuffer(b"".join(each), np.uint32)
        sizes = np.array([len(x) >> 2 for x in each], np.int64)
        begin = np.cumsum(sizes) - sizes
        n = sizes[index]
        ends_ = np.cumsum(n)
        take = np.arange(int(ends_[-1])) + np.repeat(begin[index] - (ends_ - n), n)
        return flat[take], np.bincount(rows, n, minlength=len(off) - 1).astype(np.int64)


def tokenise(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) to pieces (doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit words.

    A document is its ids by the library for the byte-level BPE file at path, then end; null text is empty and so has end alone. Only documents
    above capacity are cut: every piece but the first is full. Rows that repeat are pieces of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        encoder.model.library.no_truncation()
        for batch in batches:
            for row, buf, off in slabs(batch.column(1), SLAB):
                ids, counts = encoder.ids(buf, off)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                of = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lead = counts - (pieces - 1) * capacity  # length of the first piece
                length = np.where(piece == 0, lead[of], capacity)
                start = np.where(piece == 0, 0, lead[of] + (piece - 1) * capacity)
                bounds = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                doc = batch.column(0).slice(row, len(counts)).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place there: largest first, each into the fullest bin that still has room."""
    spare: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r places left exists
    bins, places, n = [0] * len(sizes), [0] * len(sizes), 0
    size_of = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = size_of[i]
        if fits := some >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = spare[left].pop()
            if not spare[left]:
                some ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i], places[i] = b, capacity - left
        if left := left - size:
            spare[left].append(b)
            some |= 1 << left
    return np.array(bins, np.int64), np.array(places, np.int64)


def _pack_round(capacity: int, near: int, items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            fill = whole.column("fill").to_numpy()
            bins, places = best_fit(fill, capacity)
            order = np.lexsort((places, bins))
            lists = pa.concat_arrays(whole.column("members").chunks) if whole.num_rows else None
            per = np.asarray(lists.value_lengths())[order].astype(np.int64)
            lists = lists.take(pa.array(order))
            flat = lists.flatten()
            fields = {f.name: flat.field(f.name) for f in flat.type}
            fields["offset"] = pa.array(np.asarray(fields["offset"]) + np.repeat(places[order], per))
            members = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
            in_bin = bins[order]
            n = int(in_bin[-1]) + 1
            inside = np.bincount(in_bin, per, minlength=n).astype(np.int64)
            total = np.bincount(bins, fill, minlength=n).astype(np.int64)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inside)]).astype(np.int32)), members)
            for at in range(0, n, 2000):
                yield pa.RecordBatch.from_arrays([pa.array(total[at : at + 2000]), pa.array(capacity - total[at : at + 2000] <= near), out[at : at + 2000]], names=["fill", "done", "members"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= items:
                yield from packed()
        if sum(x.num_rows for x in held):
            yield from packed()

    return run


def pack(pieces: DataFrame, store: Store, capacity: int = 1024, task_items: int = TASK_ITEMS) -> DataFrame:
    """pieces(length, ...) to the same rows with sequence_id and offset; each length is from 1 to capacity.

    Places in a sequence have no gaps from 0. Bins with at most capacity/128 places left are final after the round that made them. Rounds go on
    until the rest fits one task, or until a round over many tasks joins no bins any more. Other columns travel along unread; an empty
    table gives an empty result; repeated rows are packed each.
    """
    names = [c for c in pieces.columns if c != "offset"]
    members = F.array(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("offset"))).alias("members")
    rows = pieces.select(F.col("length").cast("long").alias("fill"), (F.col("length") == capacity).alias("done"), members)
    schema = f"fill long, done boolean, members {rows.schema['members'].dataType.simpleString()}"
    rows = store.cut(rows, "pieces")
    finished = [rows.where("done")]
    rest, left, k = rows.where("not done"), None, 0
    while True:
        before, k = left, k + 1
        packed = store.cut(rest.mapInArrow(_pack_round(capacity, capacity // 128, task_items), schema), f"round-{k}")
        finished.append(packed.where("done"))
        rest = packed.where("not done")
        left = rest.count()
        if left == 0 or last_round(k, left, before, task_items):
            break
        rest = rest.repartition(-(-left // task_items))
        if left <= task_items:
            before, k = left, k + 1
            packed = store.cut(rest.mapInArrow(_pack_round(capacity, capacity, task_items + 1), schema), f"round-{k}")
            finished.append(packed)
            rest = None
            break
    if rest is not None and left:
        finished.append(rest)
    out = finished[0]
    for f in finished[1:]:
        out = out.union(f)
    numbered = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")  # a row is a bin; the tables are written, so numbers hold
    return numbered.select("sequence_id", F.explode("members").alias("m")).select(*[F.col(f"m.`{c}`") for c in names], "sequence_id", "m.offset")


def last_round(k: int, left: int, before: int | None, task_items: int) -> bool:
    """Whether a round over many tasks, which deals bins anew, joined none of them any more."""
    return left > task_items and before is not None and left >= before
