"""Line dedup within an edit bound, by prefixes of word pairs.

A line is its sequence of words. A line may differ from an earlier one by one inserted, deleted or replaced word for each FUZZY_WORDS of the shorter.

An edit touches two of a line's pairs of neighbouring words at most. So of two lines that are k edits apart, each has at most 2k pairs (repeats are
numbered) that the other has not; if all pairs are put in one order, whichever it is, their first 2k + 1 pairs have one in common. These are a line's keys.
The order only steers the cost: pairs that are rare in a sample come first, so that lines seldom share a key unless they are alike.

Members of a key are compared with each other if they are few; if they are a crowd, with the earliest first, and what that leaves open with all earlier
ones. No two lines are compared whose parities of words by hash bucket differ in more places than the edits allow, and texts are fetched only
for lines that are left in a pair.
"""

from __future__ import annotations

import functools

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Store, id_key, small
from .textbytes import BASE, BASE_2, inverse_powers, mix, powers, prefix_sums, slabs, span_hash, word_spans

#: Lines of fewer words are left alone: only those without words.
LEAST_WORDS = 1
#: A line may differ by one word for each so many words of the shorter of two lines; shorter lines go only if an earlier line is equal.
FUZZY_WORDS = 10
#: Lines of a key up to which all are compared with each other at once; of a larger one, first with its earliest line.
CROWD = 8
#: Documents, about, from which it is learned which words and pairs of words are common, and how many of either are kept. Results do not depend on them.
SAMPLE, COMMON = 8000, 1 << 16
#: Places of the tables of common words and pairs, and lines that are sorted at once.
PLACES, AT_ONCE = 1 << 20, 1 << 16
#: 64-bit numbers of a line's odd sketch, the parities of its words' counts by hash bucket: an edit flips two of them at most.
SKETCH = "abcdef"


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def _span(sums: np.ndarray, s: np.ndarray, e: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[e] - sums[s]) * inverse_powers(base, len(sums) + 1)[s] + (e - s).astype(np.uint64))


def line_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and of each line that has words: its first word, the end of its words, its row and its number in the row, as three arrays."""
    starts, ends, rows = word_spans(buf, off)
    word = span_hash(prefix_sums(buf, BASE), starts, ends, BASE)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    number = breaks[starts] - breaks[off[rows]]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(word)) if len(first) else first
    return word, first, last, np.stack([rows[first], number[first]]) if len(first) else np.empty((2, 0), np.int64)


def _pairs(word: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, hash) of each pair of neighbouring words of lines that start at s and have n words."""
    line = np.repeat(np.arange(len(n)), n - 1)
    at = np.arange(len(line)) + np.repeat(s - (np.cumsum(n - 1) - (n - 1)), n - 1)
    return line, at, mix(word[at] * np.uint64(BASE) + word[at + 1])


def _count_common(least: int, fuzzy: int):
    """Words and pairs of words (two) with their number in a batch, of lines that may have keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off in slabs(batch.column(0)):
                word, s, e, _ = line_words(buf, off)
                keep = e - s >= max(least, fuzzy)
                _, at, pair = _pairs(word, s[keep], (e - s)[keep])
                for two, found in ((False, word[at]), (True, pair)):
                    h, c = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), two)), pa.array(h.view(np.int64)), pa.array(c)], names=["two", "h", "c"])

    return run


def _common(texts: DataFrame, store: Store, least: int, fuzzy: int) -> list[np.ndarray]:
    """Of words and of pairs: how common they are in a sample of texts(id, th, t), four times the logarithm of their count, by the last bits of their hash."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("id", "th"), F.lit(every)) == 0).select("t")
    counts = some.mapInArrow(_count_common(least, fuzzy), "two boolean, h long, c long").groupBy("two", "h").agg(F.sum("c").alias("c")).where("c > 1")
    counts = store.cut(counts, "counts")  # read twice
    out = []
    for two in (False, True):
        top = counts.where(F.col("two") == two).orderBy(F.desc("c"), "h").limit(COMMON).select("h", "c").toArrow()
        table = np.zeros(PLACES, np.uint8)
        place = np.asarray(top.column(0)).astype(np.int64) & (PLACES - 1)
        np.maximum.at(table, place, np.minimum(4 * np.log2(np.asarray(top.column(1)).astype(np.int64)), 127).astype(np.uint8))
        out.append(table)
    store.free("counts")
    return out


def line_keys(word: np.ndarray, s: np.ndarray, n: np.ndarray, fuzzy: int, common: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many of each line) of lines of fuzzy words and more that start at s and have n words: of each its first 2 * (n // fuzzy) + 1 pairs."""
    take = 2 * (n // fuzzy) + 1
    known = common[0][word & np.uint64(PLACES - 1)]
    out = [np.empty(0, np.uint64)]
    for a in range(0, len(n), AT_ONCE):
        size, first = n[a : a + AT_ONCE] - 1, take[a : a + AT_ONCE]
        line, at, pair = _pairs(word, s[a : a + AT_ONCE], size + 1)
        seen = common[1][pair & np.uint64(PLACES - 1)]
        rank = np.where(seen > 0, seen | np.uint8(128), np.minimum(known[at].astype(np.uint16) + known[at + 1], 127)).astype(np.uint64)
        # of a line in turn, 8 bits of rank and 40 of the hash
        value = np.sort(line.astype(np.uint64) << np.uint64(48) | rank << np.uint64(40) | pair >> np.uint64(24))
        fresh = np.ones(len(value), bool)
        fresh[1:] = value[1:] != value[:-1]
        begin = np.cumsum(size) - size
        kept = np.arange(int(first.sum())) + np.repeat(begin - (np.cumsum(first) - first), first)
        number = kept - np.flatnonzero(fresh)[np.cumsum(fresh)[kept] - 1]
        out.append(mix((value[kept] & np.uint64((1 << 48) - 1)) + number.astype(np.uint64) * np.uint64(BASE_2)))
    return np.concatenate(out), take


def sketches(word: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The odd sketches of lines that start at s and have n words, a number at a time."""
    line = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(line)) + np.repeat(s - (np.cumsum(n) - n), n)
    out = []
    begin = np.cumsum(n) - n
    place = word[at] % np.uint64(64 * len(SKETCH))
    bit, number = np.uint64(1) << (place & np.uint64(63)), (place >> np.uint64(6)).astype(np.uint8)
    for k in range(len(SKETCH)):
        part = np.where(number == k, bit, np.uint64(0))
        out.append(np.bitwise_xor.reduceat(part, begin) if len(n) else part)
    return out


def _long_list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


#: Places of a line: the document's id, a hash of its text, and the line's number.
_SKETCH = f"struct<{','.join(f'{c}:long' for c in SKETCH)}>"
_PLACE, _AT = "id long, th long, line long", "struct<id:long,th:long,line:long>"


def _list_lines(least: int, fuzzy: int, common: list[np.ndarray] | None = None):
    """Content hashes of every line; with common words and pairs, also keys and sketch of those for which the bound is a word or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, off in slabs(batch.column(2)):
                word, s, e, where = line_words(buf, off)
                keep = e - s >= least
                s, e, where = s[keep], e[keep], where[:, keep]
                if not len(s):
                    continue
                n = e - s
                one, two = _sums(word, BASE), _sums(word, BASE_2)
                at = pa.array(where[0] + row)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(where[1]), pa.array(_span(one, s, e, BASE).view(np.int64)), pa.array(_span(two, s, e, BASE_2).view(np.int64)), pa.array(n)]
                if common:
                    far = np.flatnonzero(n >= fuzzy)
                    key, count = line_keys(word, s[far], n[far], fuzzy, common)
                    counts = np.zeros(len(n), np.int64)
                    counts[far] = count
                    columns.append(_long_list(key, counts))
                    parts = []
                    for bits in sketches(word, s[far], n[far]):
                        part = np.zeros(len(n), np.uint64)
                        part[far] = bits
                        parts.append(pa.array(part.view(np.int64)))
                    columns.append(pa.StructArray.from_arrays(parts, names=list(SKETCH)))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "line", "h1", "h2", "n", "keys", "sketch"][: len(columns)])

    return run


def _fetch_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the wanted lines of each text; of rows that repeat one after the other, of the first."""
    last = None
    for batch in batches:
        places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        batch = batch.filter(pa.array([a != b for a, b in zip(places, [last, *places], strict=False)], pa.bool_()))
        last = places[-1] if places else last
        for row, buf, off in slabs(batch.column(2)):
            word, s, e, where = line_words(buf, off)
            wanted = batch.column(3).slice(row, len(off) - 1)
            owner = np.repeat(np.arange(len(wanted)), np.asarray(wanted.value_lengths()))
            keys = np.asarray(wanted.flatten()).astype(np.int64) * len(wanted) + owner
            take = np.flatnonzero(np.isin(where[1] * len(wanted) + where[0], keys))
            n = (e - s)[take]
            at = np.repeat(s[take] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            rows = pa.array(where[0][take] + row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(where[1][take]), pa.array(n), _long_list(word[at], n)], names=["id", "th", "line", "n", "words"])


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most so many words inserted, deleted or replaced turn a into b: of each diagonal, the furthest place that so many edits reach."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return False
    both = min(la, lb)
    ahead, behind = a[:both] != b[:both], a[la - both :] != b[lb - both :]
    if not ahead.any() or not behind.any() or (la == lb and ahead.sum() <= most):
        return True
    # what is equal at both ends needs no edits
    head = int(ahead.argmax())
    tail = min(int(behind[::-1].argmax()), both - head)
    a, b = a[head : la - tail].astype(np.uint64), b[head : lb - tail].astype(np.uint64)
    la, lb = len(a), len(b)
    if max(la, lb) <= most:
        return True
    if np.isin(a, b, invert=True).sum() > most or np.isin(b, a, invert=True).sum() > most:
        return False
    twos = [x[:-1] * np.uint64(BASE) + x[1:] for x in (a, b)]  # an edit touches two pairs of neighbours of either at most
    if np.isin(*twos, invert=True).sum() > 2 * most or np.isin(*twos[::-1], invert=True).sum() > 2 * most:
        return False
    sa, sb, inverse = _sums(a, BASE), _sums(b, BASE), inverse_powers(BASE, max(la, lb) + 1)

    def slide(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """i and as many words more as are equal from place i of a and i + d of b; by bisection over hashes of spans."""
        i = i.copy()
        room = np.minimum(la - i, lb - i - d)
        go = np.flatnonzero(room > 0)
        go = go[a[i[go]] == b[i[go] + d[go]]]
        if len(go):
            at, to, low, high = i[go], i[go] + d[go], np.ones(len(go), np.int64), room[go]
            while (low < high).any():
                middle = (low + high + 1) // 2
                same = (sa[at + middle] - sa[at]) * inverse[at] == (sb[to + middle] - sb[to]) * inverse[to]
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            i[go] += low
        return i

    none = -2  # no such place
    far = np.full(2 * most + 3, none, np.int64)  # of the diagonals from -most - 1 to most + 1
    far[most + 1] = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for edits in range(1, most + 2):
        if far[most + 1 + lb - la] >= la:
            return True
        if edits > most:
            return False
        d = np.arange(-edits, edits + 1)
        at = d + most + 1
        i = np.maximum(np.maximum(far[at] + 1, far[at - 1]), far[at + 1] + 1)
        i = np.minimum(np.minimum(i, la), lb - d)
        ok = i >= np.maximum(0, -d)
        new = np.full(len(d), none, np.int64)
        new[ok] = slide(i[ok], d[ok])
        far[at] = new
    return False


def _verify(fuzzy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((np.asarray(a.values), np.asarray(b.values)) for a, b in zip(batch.column(1), batch.column(2), strict=True))
            ok = [within(a, b, min(len(a), len(b)) // fuzzy) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["at"]).filter(pa.array(ok, pa.bool_()))

    return run


def _judged(pairs: DataFrame, words: DataFrame, store: Store, name: str, fuzzy: int) -> DataFrame:
    """pairs(at, to) to the distinct at that are within the bound of their to."""
    theirs = words.select(F.col("at").alias("to"), F.col("words").alias("theirs"))
    both = pairs.join(words.select("at", "words"), "at").join(theirs, "to").select("at", "words", "theirs")
    return store.cut(both.mapInArrow(_verify(fuzzy), f"at {_AT}").distinct(), name)


def _alike(n: str, to_n: str, sketch: str, to_sketch: str, fuzzy: int) -> Column:
    """Whether lengths and sketches leave room for the bound."""
    most = F.floor(F.least(n, to_n) / fuzzy)
    apart = functools.reduce(Column.__add__, [F.bit_count(F.col(f"{sketch}.{c}").bitwiseXOR(F.col(f"{to_sketch}.{c}"))) for c in SKETCH])
    return (F.abs(F.col(n) - F.col(to_n)) <= most) & (apart <= 2 * most)


_MEMBER = ["key", "at", "n", "sketch"]
#: Least keys of a line that its members carry: a pair is made at the least key that both carry, and not once for each key that it shares.
FIRST = 8


def _led(members: DataFrame, fuzzy: int) -> DataFrame:
    """(at, to): members(key, at, n, sketch) with the earliest of one of their keys, if it may be within the bound."""
    leaders = members.groupBy("key").agg(F.min(F.struct("at", "n", "sketch")).alias("p"))
    return members.join(leaders, "key").where((F.col("p.at") < F.col("at")) & _alike("n", "p.n", "sketch", "p.sketch", fuzzy)).select("at", F.col("p.at").alias("to")).distinct()


def _members(lines: DataFrame, keys: str) -> DataFrame:
    """A member(key, at, n, sketch, first) for each of the sorted keys of lines(at, n, sketch, ...)."""
    return lines.select(F.explode(keys).alias("key"), "at", "n", "sketch", F.slice(keys, 1, FIRST).alias("first"))


def _met(members: DataFrame, fuzzy: int, late: DataFrame | None = None) -> DataFrame:
    """(at, to), seldom twice: members(key, at, n, sketch, first) not yet late with the earlier ones of their keys that may be within the bound.

    Lines that share many keys would meet at each of them; they meet at the least that both carry, or else at every one that is later than what they carry.
    """
    earlier = members.select("key", F.col("at").alias("to"), F.col("n").alias("to_n"), F.col("sketch").alias("to_sketch"), F.col("first").alias("to_first"))
    later = members.join(late, "at", "left_anti") if late is not None else members
    once = F.coalesce(F.array_min(F.array_intersect("first", "to_first")) >= F.col("key"), F.lit(True))
    return later.join(earlier, "key").where((F.col("to") < F.col("at")) & _alike("n", "to_n", "sketch", "to_sketch", fuzzy) & once).select("at", "to")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("at").unionByName(pairs.select(F.col("to").alias("at"))).distinct()


def _fetched(texts: DataFrame, lines: DataFrame, store: Store, name: str) -> DataFrame:
    """(at, n, words) of lines(at) from texts(id, th, t), once each."""
    wanted = store.cut(lines.groupBy("at.id", "at.th").agg(F.collect_list("at.line").alias("wanted")), f"{name}-wanted")
    # no other text is dealt out, if a broadcast can tell; sorted by id and th, so that rows that repeat come one after the other and are read once
    some = texts.join(small(wanted.select("id", "th")), ["id", "th"], "left_semi")
    words = some.join(wanted.hint("merge"), ["id", "th"]).select("id", "th", "t", "wanted").mapInArrow(_fetch_lines, f"{_PLACE}, n long, words array<long>")
    words = store.cut(words.select(F.struct("id", "th", "line").alias("at"), "n", "words"), name)
    store.free(f"{name}-wanted")
    return words


def repeated_lines(docs: DataFrame, store: Store, least: int = LEAST_WORDS, fuzzy: int = FUZZY_WORDS, crowd: int = CROWD) -> DataFrame:
    """docs(doc_id, text, ...) to (id, th, gone): for each text that loses any, the numbers from 0 of the lines that go.

    id is the doc_id, or the largest long for rows without one, and th a hash of the text. Lines come in the order of id, th and line number. A line of at
    least `least` words goes if an earlier line has the same words or is within one inserted, deleted or replaced word for each `fuzzy` words of
    the shorter, whether or not that line itself goes. Null texts have no lines. Rows that repeat both a doc_id and its text share their decisions; rows that repeat
    a doc_id with another text have their own. Other columns are ignored; an empty table gives an empty result.
    """
    if fuzzy < 4:
        raise ValueError("fuzzy must be 4 at least")  # or a line may have fewer pairs than keys
    texts = docs.select(id_key().alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("t"))
    content = ["h1", "h2", "n"]
    named = f"{_PLACE}, h1 long, h2 long, n long"
    listed = texts.mapInArrow(_list_lines(least, fuzzy, _common(texts, store, least, fuzzy)), f"{named}, keys array<long>, sketch {_SKETCH}")
    keyed = store.cut(listed.groupBy(*content).agg(F.min(F.struct("id", "th", "line")).alias("at"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("keys", "sketch")]), "keyed")
    keys = keyed.select("h1", F.explode("keys").alias("key"))
    shared = store.cut(keys.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1"), "shared")
    classes = store.cut(keyed.select(*content, "at", "size", "sketch"), "classes")
    store.free("keyed")
    # keys of few lines and of crowds apart, as a pair is looked for among either
    of_line = shared.groupBy("h1").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("key")))).alias(k) for k, c in (("few", F.col("m") <= crowd), ("crowd", F.col("m") > crowd))])
    members = store.cut(of_line.join(classes.select("h1", "n", "at", "sketch"), "h1").drop("h1"), "members")
    store.free("shared")
    crowded = _members(members, "crowd")
    led = store.cut(_met(_members(members, "few"), fuzzy).unionByName(_led(crowded.select(_MEMBER), fuzzy)).distinct(), "led")
    words = _fetched(texts, _ends(led), store, "words")
    late = _judged(led, words, store, "led-late", fuzzy)
    met = store.cut(_met(crowded, fuzzy, late).distinct().join(led, ["at", "to"], "left_anti"), "met")
    words = words.unionByName(_fetched(texts, _ends(met).join(words.select("at"), "at", "left_anti"), store, "more-words"))
    late = store.cut(late.unionByName(_judged(met, words, store, "met-late", fuzzy)).distinct(), "late")
    store.free("members", "words", "more-words", "led", "led-late", "met", "met-late")
    # a class whose first line goes loses all its lines, any other class all but the first
    settled = classes.join(late.withColumn("late", F.lit(True)), "at", "left").where("late or size > 1")
    settled = store.cut(settled.select(*content, "at", F.coalesce("late", F.lit(False)).alias("late")), "settled")
    store.free("classes", "late")
    lines = texts.mapInArrow(_list_lines(least, fuzzy), named)
    gone = lines.join(settled, content).where(F.col("late") | (F.struct("id", "th", "line") != F.col("at")))
    return gone.groupBy("id", "th").agg(F.collect_set("line").alias("gone"))


def without_repeated_lines(docs: DataFrame, store: Store, **how) -> DataFrame:
    """docs with an added struct column lines(total, removed); text holds the lines that stay, in their order, null text stays null.

    n_chars, where there is such a column, follows the text. Rows of documents that lose nothing are as they were.
    """
    gone = store.cut(repeated_lines(docs, store, **how), "gone")
    names = docs.columns
    keyed = docs.select(id_key().alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = keyed.join(gone, (keyed["_id"] == gone["id"]) & (keyed["_th"] == gone["th"]), "left")
    parts = F.split(F.col("row.text"), "\n", -1)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i.cast("long"))), "\n"))
    row = F.col("row").withField("text", text)
    total = F.length("row.text") - F.length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1  # texts that lose nothing are not split
    joined = joined.select(row.alias("row"), F.struct(F.coalesce(total, F.lit(0)).cast("long").alias("total"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed")).alias("lines"))
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        joined = joined.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("lines.removed") > 0, F.length("row.text").cast(kind)).otherwise(F.col("row.n_chars"))))
    return joined
