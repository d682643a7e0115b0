"""GeoJSON collections of any size and layout, read by pieces.

A file is read as text that ends at each closing brace, which every layout has, in as many splits as Spark makes. How deep in the document a split begins,
and whether within a string, follows from the splits before it: a first pass sums up each split for either case. A second pass finds the array of features and
counts them, a third one gives their texts. Features that lie across splits are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DELTA = np.zeros(256, np.int8)
_DELTA[[ord("{"), ord("[")]] = 1
_DELTA[[ord("}"), ord("]")]] = -1
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_NAME = re.compile(rb'"properties"\s*:\s*\{[^}]*?"name"\s*:\s*"((?:[^"\\]|\\.)*)"')


@dataclass
class Start:
    """How a split begins: within a string, how deep, within the features, and how many features began before it."""

    quoted: int = 0
    depth: int = 0
    inside: bool = False
    ordinal: int = 0


@dataclass
class Layout:
    splits: DataFrame
    starts: dict[tuple[str, int], Start]
    crs: str | None


def _quotes(at: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that opens or closes a string."""
    found = at == _QUOTE
    places = np.flatnonzero(found)
    for i in places[at[places - 1] == _BACKSLASH].tolist():
        k = i - 1
        while k >= 0 and at[k] == _BACKSLASH:
            k -= 1
        if i > 0 and (i - 1 - k) % 2:
            found[i] = False
    return found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(split, text) of batches of (file, start, value): texts of one split come one after the other."""
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys = list(zip(files, starts, strict=True))
        values = batch.column(2).cast(pa.binary()).to_pylist()
        a = 0
        for b in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
            if b > a:
                yield keys[a], b"}".join(values[a:b]) + b"}"
            a = b


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: the parity of its quotes, and how much deeper it ends if it begins outside a string, and within one."""
    found: dict[tuple[str, int], list[int]] = {}
    for key, text in _runs(batches):
        now = found.setdefault(key, [0, 0, 0])
        at = np.frombuffer(text, np.uint8)
        quoted = (np.cumsum(_quotes(at)) + now[0]) & 1
        delta = _DELTA[at]
        within = int(delta[quoted == 1].sum())
        now[1] += int(delta.sum()) - within
        now[2] += within
        now[0] = int(quoted[-1])
    rows = [(*k, *v) for k, v in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)], names=["file", "start", "flips", "outside", "within"])


def _events(at: np.ndarray, quoted: int, depth: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """(place, byte, depth before it) of braces and brackets that open or close a root's member or a member's element; state at the end."""
    parity = (np.cumsum(_quotes(at)) + quoted) & 1
    delta = _DELTA[at]
    place = np.flatnonzero((delta != 0) & (parity == 0))
    step = delta[place].astype(np.int64)
    before = depth + np.cumsum(step) - step
    wanted = ((step > 0) & ((before == 1) | (before == 2))) | ((step < 0) & ((before == 2) | (before == 3)))
    return list(zip(place[wanted].tolist(), at[place[wanted]].tolist(), before[wanted].tolist(), strict=True)), int(parity[-1]), int(depth + step.sum())


def _key_before(text: bytes, place: int) -> bytes | None:
    found = _KEY.search(text, max(0, text.rfind(b"}", 0, place)), place)
    return found.group(1) if found else None


def _count(starts: dict[tuple[str, int], Start]):
    """(file, start, number in the split, what, value): arrays of features that open (1) or close (0), features that began since (2), the name of a crs (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        state: dict[tuple[str, int], tuple[int, int]] = {}
        for key, text in _runs(batches):
            rows = found.setdefault(key, [[2, 0, None]])
            quoted, depth = state.get(key) or (starts[key].quoted, starts[key].depth)
            at = np.frombuffer(text, np.uint8)
            events, quoted, depth = _events(at, quoted, depth)
            state[key] = quoted, depth
            for place, byte, before in events:
                if before == 1 and byte == ord("["):
                    if _key_before(text, place) == b"features":
                        rows += [[1, 0, None], [2, 0, None]]
                elif before == 2 and byte == ord("]"):
                    rows += [[0, 0, None], [2, 0, None]]
                elif before == 2 and byte == ord("{"):
                    rows[-1][1] += 1
                elif before == 1 and byte == ord("{") and _key_before(text, place) == b"crs":
                    name = _NAME.search(text, place, text.index(b"}", place))
                    rows += [[3, 0, name.group(1).decode() if name else None], [2, 0, None]]
        out = [(*k, i, *r) for k, rows in found.items() for i, r in enumerate(rows) if r[0] != 2 or r[1]]
        if out:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "start", "i", "what", "n", "name"])

    return run


def _texts(starts: dict[tuple[str, int], Start]):
    """(file, ordinal, start, whole, text) of features; of those that lie across splits, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s, held, rows = None, Start(), [], []

        def ended() -> None:
            if held:
                rows.append((key[0], s.ordinal - 1, key[1], False, b"".join(held)))
                held.clear()

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "ordinal", "start", "whole", "text"])
            rows.clear()
            return made

        whole = True
        for now, text in _runs(batches):
            if now != key:
                ended()
                key, s = now, Start(**vars(starts[now]))
                going, whole = s.inside and s.depth >= 3, False  # a feature that began before the split
            at = np.frombuffer(text, np.uint8)
            events, quoted, depth = _events(at, s.quoted, s.depth)
            first = 0
            for place, byte, before in events:
                if before == 1 and byte == ord("["):
                    s.inside = _key_before(text, place) == b"features"
                elif before == 2 and byte == ord("]"):
                    s.inside = False
                elif s.inside and before == 2 and byte == ord("{"):
                    first, going, whole = place, True, True
                    s.ordinal += 1
                elif going and before == 3 and byte == ord("}"):
                    held.append(text[first : place + 1])
                    rows.append((key[0], s.ordinal - 1, key[1], whole, b"".join(held)))
                    held.clear()
                    going = False
            if going:
                held.append(text[first:])
            s.quoted, s.depth = quoted, depth
            if rows:
                yield batch()
        ended()
        if rows:
            yield batch()

    return run


def layout(spark: SparkSession, path: str) -> Layout:
    """Where the features of the collections at path are."""
    splits = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    starts: dict[tuple[str, int], Start] = {}
    before: dict[str, Start] = {}
    # a row for each split, some megabytes of text
    for r in sorted(splits.mapInArrow(_summary, "file string, start long, flips long, outside long, within long").collect(), key=lambda r: (r["file"], r["start"])):
        s = before.get(r["file"], Start())
        starts[r["file"], r["start"]] = s
        before[r["file"]] = Start(s.quoted ^ r["flips"], s.depth + (r["within"] if s.quoted else r["outside"]))
    crs = None
    inside: dict[str, bool] = {}
    began: dict[str, int] = {}
    found = splits.mapInArrow(_count(starts), "file string, start long, i long, what long, n long, name string").collect()
    events: dict[tuple[str, int], list] = {}
    for r in sorted(found, key=lambda r: (r["file"], r["start"], r["i"])):
        events.setdefault((r["file"], r["start"]), []).append(r)
    for key in sorted(starts):
        starts[key].inside, starts[key].ordinal = inside.get(key[0], False), began.get(key[0], 0)
        for r in events.get(key, []):
            if r["what"] == 3:
                crs = crs or r["name"]
            elif r["what"] == 2:
                began[key[0]] = began.get(key[0], 0) + (r["n"] if inside.get(key[0]) else 0)
            else:
                inside[key[0]] = bool(r["what"])
    return Layout(splits, starts, crs)


def feature_texts(found: Layout) -> DataFrame:
    """(ordinal, text): the features of each file in their order, as JSON."""
    rows = found.splits.mapInArrow(_texts(found.starts), "file string, ordinal long, start long, whole boolean, text string")
    if len(found.starts) < 2:
        return rows.select("ordinal", "text")
    parts = rows.where("not whole").groupBy("file", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text"))
    return rows.where("whole").select("ordinal", "text").unionByName(parts.select("ordinal", "text"))
