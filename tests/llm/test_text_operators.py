import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netloom.llm import exact, lines, packing, pretoken, queries, suffix, tokens
from netloom.llm.textbytes import slabs
from netloom.store import Store

SPACE = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def model():
    return pretoken.ByteLevel(queries.vocabulary())


TRICKY = ["", " ", "a  b", "a \n b", "don't 're'll x''s 's's 'ss '", "it's I'm you'LL he'd'd", "x　y\xa0z", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>  ", "<|endof", "½ ٣ 日本語😀 é", "!!  ?? '' '", "x" * 2000, "ab " * 900, "\r\n\r\n a\x1cb\x85c"]


def test_counts_and_ids_are_the_librarys(model):
    random.seed(1)
    all_ = TRICKY + ["".join(random.choice("aB's tlrevmd  \n\t1é½!<|>日̀") for _ in range(random.randint(0, 30))) for _ in range(2000)]
    expected = [e.ids for e in model.library.encode_batch(all_, add_special_tokens=False)]
    assert tokens._Counter(queries.vocabulary()).counts(pa.array(all_)).tolist() == [len(e) for e in expected]
    encoder, got = packing._Encoder(queries.vocabulary()), []
    for _, buf, off in slabs(pa.array(all_)):
        ids, n = encoder.ids(buf, off)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == expected


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_counts_as_in_the_library(text):
    model = pretoken.ByteLevel(queries.vocabulary())
    got = test_any_text_counts_as_in_the_library.counter.counts(pa.array([text]))[0]
    assert got == len(model.library.encode(text, add_special_tokens=False).ids)


test_any_text_counts_as_in_the_library.counter = tokens._Counter(queries.vocabulary())


def test_token_counts_query(spark, sf_dir, texts, model, awkward, empty):
    rows = {r["doc_id"]: r for r in queries.op10_token_counts(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        n = len(model.library.encode(t, add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len(t.encode()), n, n > 512)
    assert tokens.token_counts(awkward, queries.vocabulary()).count() == 9
    assert tokens.token_counts(empty, queries.vocabulary()).count() == 0


def check_packing(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length >= 1
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, sf_dir, texts, model):
    import zlib

    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    bins = check_packing(rows)
    assert bins <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids = [*model.library.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_rounds_and_awkward_rows(spark, store, awkward, empty):

    pieces = spark.range(5000).select((F.abs(F.xxhash64("id")) % 700 + 1).alias("length"), F.col("id").alias("fill"), F.lit(1).alias("offset"))
    rows = packing.pack(pieces, store, task_items=300).collect()
    assert len(rows) == 5000 and check_packing(rows) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 2
    same = packing.pack(spark.range(500).select(F.lit(600).cast("long").alias("length")), Store(spark, "t"), task_items=50).collect()
    assert check_packing(same) == 500
    assert packing.pack(packing.tokenise(awkward, queries.vocabulary()), Store(spark, "t")).where("length > 1024").count() == 0
    assert packing.pack(packing.tokenise(empty, queries.vocabulary()), Store(spark, "t")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 9000))
def test_fingerprints_compose(data, at):
    a, b = np.frombuffer(data[:at], np.uint8), np.frombuffer(data[at:], np.uint8)
    whole = exact.fingerprint(np.frombuffer(data, np.uint8))
    assert exact.combine(exact.fingerprint(a), exact.fingerprint(b), len(b)).tolist() == whole.tolist()
    assert whole.tolist() == [sum(c * pow(x, len(data) - 1 - i, exact.PRIME) for i, c in enumerate(data)) % exact.PRIME for x in exact.POINTS]


def expected_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("bits,segment", [(31, exact.SEGMENT), (31, 700), (1, 700)])
def test_exact_dedup(store, documents, texts, bits, segment):
    got = {r["doc_id"]: tuple(r)[1:] for r in exact.exact_dedup(documents, store, bits, segment).collect()}
    assert got == expected_copies(texts.items())


def test_exact_dedup_awkward(store, awkward, empty):
    rows = exact.exact_dedup(awkward, store, segment=1000).collect()
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows)
    assert got == [(0, 0, 1, True), (1, 1, 1, True), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 6, 2, True), (6, 6, 2, True), (7, 7, 1, True)]
    assert exact.exact_dedup(empty, Store(empty.sparkSession, "t")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_suffix_array(values):
    text = [*values, 0]
    assert suffix.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def expected_removal(rows, length):
    starts = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = {}
    for key, b in rows:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(cover)))
        kept = bytes(c for c, gone in zip(b, cover, strict=True) if not gone)
        out.setdefault(key, []).append((len(b), len(b) - len(kept), runs, kept))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_runs": 3}, {"task_bytes": 20_000}])
def test_repeated_strings(store, documents, texts, how):
    some = sorted(texts)
    rows = [(i, texts[i].encode()) for i in some]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.without_repeated_strings(documents, store, **how).collect()}
    expected = {i: v[0] for i, v in expected_removal(rows, suffix.LENGTH).items()}
    assert got == expected
    assert sum(v[1] for v in got.values()) > 0


def test_repeated_strings_in_pieces_and_awkward(store, awkward, empty, monkeypatch):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect()]
    got = {}
    for r in suffix.without_repeated_strings(awkward, store).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    assert got == expected_removal(rows, suffix.LENGTH)
    assert suffix.without_repeated_strings(empty, Store(empty.sparkSession, "t")).count() == 0
    monkeypatch.setattr(suffix, "PIECE", 1000)
    monkeypatch.setattr("netloom.llm.textbytes.SLAB", 1000)
    text = pa.array(["q" + "abcd" * 900])
    seen = []
    for row, at, buf, off in suffix._pieces(text, 200):
        _, first, count, *_ = suffix.anchors(buf, off, 200, 48)
        seen += [at + f + j for f, c in zip(first.tolist(), count.tolist(), strict=True) for j in range(c)]
    assert sorted(seen) == list(range(3601 - 199))


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def expected_lines(rows, least=lines.LEAST_WORDS, fuzzy=lines.FUZZY_WORDS):
    """Brute force: every line against all earlier ones. rows are (place, text); places come in order."""
    earlier, gone, seen = {}, {}, set()
    for i, t in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            w = tuple(x for x in SPACE.split(line) if x)
            if len(w) < least:
                continue
            bag, n = Counter(w), len(w)
            near = False
            if w not in seen and n >= fuzzy:
                for m in range(n - n // fuzzy, n + n // fuzzy + 1):
                    most = min(m, n) // fuzzy
                    # words that one line has and the other has not are a lower bound of the edits
                    near = near or any(sum((bag - other).values()) <= most and sum((other - bag).values()) <= most and edits(w, v) <= most for v, other in earlier.get(m, ()))
            if w in seen or near:
                gone.setdefault(i, set()).add(k)
            if w not in seen:
                seen.add(w)
                earlier.setdefault(n, []).append((w, bag))
    return gone


HOW = [{}, {"crowd": 1}]


@pytest.mark.parametrize("how", HOW)
def test_line_dedup(store, documents, texts, how):
    got = {r["id"]: set(r["gone"]) for r in lines.repeated_lines(documents, store, **how).collect()}
    assert got == expected_lines(texts.items())


@pytest.mark.parametrize("how", HOW)
def test_line_dedup_edits(spark, store, how):
    random.seed(3)
    base = [[f"w{random.randint(0, 40)}" for _ in range(n)] for n in (9, 10, 11, 12, 15, 40)]
    rows = []
    for i in range(150):
        out = []
        for _ in range(3):
            w = list(random.choice(base))
            for _ in range(random.randint(0, 2)):
                p = random.randrange(len(w))
                w[p : p + random.randint(0, 1)] = random.choice([[], ["new"], [f"w{random.randint(0, 40)}"]])
            out.append(" ".join(w))
        rows.append((i, "\n".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: set(r["gone"]) for r in lines.repeated_lines(docs, store, **how).collect()}
    assert got == expected_lines(rows)
    assert got


def test_line_dedup_awkward(spark, store, awkward, empty):
    found = lines.without_repeated_lines(awkward, store).select("row.*", F.col("lines").alias("_lines")).collect()
    assert len(found) == 9 and list(found[0].asDict())[:-1] == awkward.columns
    removed = sorted(((r["doc_id"] or 0, r["text"], r["_lines"]["removed"]) for r in found), key=str)
    # 2 differs from 1 by one word in 15; white space has no words; rows that repeat as a whole keep their text
    assert [x[::2] for x in removed] == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (6, 0), (7, 0)]
    assert [x[1] for x in removed if x[0] in (2, 3)] == ["", None]
    assert lines.without_repeated_lines(empty, Store(spark, "t")).count() == 0


def test_line_dedup_of_ids_with_several_texts(spark, store):
    """Rows that repeat a doc_id lose only what is repeated in them."""
    a, b, u = ("a line that two rows share", "another line that both have", "a line that is nowhere else at all")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\nsomething new here"), (2, f"{u}\n{b}"), (None, f"{a}\n{u} but one"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 9, r["text"]) for r in lines.without_repeated_lines(docs, store).select("row.*").collect())
    assert got == sorted([(1, f"{a}\n{b}"), (2, "something new here"), (2, u), (9, f"{u} but one"), (9, "")])


def test_line_dedup_very_long_text(spark, store):
    """A text of several slabs, with a near copy of its one very long line."""
    random.seed(8)
    words = [f"w{random.randint(0, 10**6)}" for _ in range(300_000)]
    other = [w if i % 400 else "x" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short\n" + " ".join(other)), (3, "short\n" + " ".join(words[::-1]))], "doc_id long, text string")
    got = {r["id"]: set(r["gone"]) for r in lines.repeated_lines(docs, store).collect()}
    assert got == {2: {1}, 3: {0}}


def test_line_dedup_short_lines(store, documents, texts):
    """However few words an exact repeat has, it goes; counted without the operator's constants."""
    seen, repeats = set(), set()
    for i, t in sorted(texts.items()):
        for k, line in enumerate(t.split("\n")):
            w = tuple(x for x in SPACE.split(line) if x)
            if w and len(w) < 10:  # longer lines may also go for another reason
                if w in seen:
                    repeats.add((i, k))
                seen.add(w)
    short = {(r["id"], k) for r in lines.repeated_lines(documents, store).collect() for k in r["gone"] if len(SPACE.split(texts[r["id"]].split("\n")[k].strip("\x20\x09\x0a\x0b\x0c\x0d"))) < 10}
    assert short == repeats
    assert any(len(texts[i].split("\n")[k].split()) < 5 for i, k in repeats)


def test_within():
    random.seed(5)
    for _ in range(2000):
        a = [random.randint(0, 3) for _ in range(random.randint(0, 12))]
        b = list(a) if random.random() < 0.7 else [random.randint(0, 3) for _ in range(random.randint(0, 12))]
        for _ in range(random.randint(0, 4)):
            p = random.randint(0, len(b))
            b[p : p + random.randint(0, 1)] = random.choice([[], [random.randint(0, 3)]])
        for most in range(6):
            assert lines.within(np.array(a), np.array(b), most) == (edits(a, b) <= most)


def test_line_keys():
    """Lines within the bound share a key, in whatever order pairs are; lines of the same words in another order seldom do."""
    random.seed(6)
    common = [np.array([random.choice([0, 0, 0, 3, 90]) for _ in range(lines.PLACES // 64)] * 64, np.uint8) for _ in range(2)]
    a, b = [], []
    for i in range(600):
        w = [random.randrange(1 << 62) if i % 2 else random.randint(0, 3) for _ in range(random.choice([10, 11, 19, 20, 35, 200]))]
        v = list(w)
        for _ in range(len(w) // 10):
            p = random.randrange(len(v))
            v[p : p + random.randint(0, 1)] = random.choice([[], [random.randint(0, 3)]])
        if edits(w, v) <= min(len(w), len(v)) // 10:
            a.append(w)
            b.append(v)
    b += [w[::-1] for w in a]

    def keys(of):
        n = np.array([len(w) for w in of])
        found, count = lines.line_keys(np.concatenate(of).astype(np.uint64), np.cumsum(n) - n, n, 10, common)
        assert (count == 2 * (n // 10) + 1).all()
        return [set(x.tolist()) for x in np.split(found, np.cumsum(count)[:-1])]

    a, b = keys(a), keys(b)
    assert len(a) > 300 and all(x & y for x, y in zip(a, b, strict=False))
    assert sum(bool(x & y) for x, y in zip(a, b[len(a) :], strict=True)) < 0.7 * len(a)


def test_line_dedup_crowded_classes_of_words(spark, store):
    """210 words, 21 of them replaced so that only crowded classes of two words are as before: such lines were left out."""
    dealt = {k: [] for k in range(50)}
    for i in range(20_000):
        word = lines.line_words(np.frombuffer(f"w{i}".encode(), np.uint8), np.array([0, len(f"w{i}")]))[0]
        dealt[int(lines.mix(word ^ np.uint64(0x5851F42D4C957F2D))[0] >> np.uint64(32)) % 50].append(f"w{i}")
    a = [w for k in range(42) for w in dealt[k][: 5 if k < 26 else 4]] + [w for k in range(42, 50) for w in dealt[k][:2]]
    other = {dealt[k][0]: dealt[k + 1][9] for k in range(0, 42, 2)}
    b = [other.get(w, w) for w in a]
    assert len(a) == 210 and sum(x != y for x, y in zip(a, b, strict=True)) == 21
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    assert [set(r["gone"]) for r in lines.repeated_lines(docs, store, crowd=1).collect()] == [{0}]


def test_line_dedup_grown_edits(spark, store):
    """Lines of every length from 18 words, with about as many edits as a tenth of the words, against all earlier lines."""
    random.seed(4)
    base = [[f"w{random.randint(0, 60)}" for _ in range(n)] for n in (18, 19, 20, 21, 29, 30, 45, 60, 101)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(3):
            w = list(random.choice(base))
            for _ in range(random.randint(1, len(w) // 8)):
                p = random.randrange(len(w))
                w[p : p + random.randint(0, 1)] = random.choice([[], ["new"], [f"w{random.randint(0, 60)}"]])
            out.append(w)
        rows.append((i, out))
    earlier, expected = [], 0
    gone = {}
    for i, out in rows:
        for k, w in enumerate(out):
            found = [d for v in earlier if abs(len(v) - len(w)) <= 12 and (d := edits(w, v)) <= min(len(v), len(w)) // 10]
            if found:
                gone.setdefault(i, set()).add(k)
                expected += min(found) >= 2
            earlier.append(w)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(w) for w in out)) for i, out in rows], "doc_id long, text string")
    found = lines.without_repeated_lines(docs, store).select("row.*").collect()
    want = {i: "\n".join(" ".join(w) for k, w in enumerate(out) if k not in gone.get(i, ())) for i, out in rows}
    assert {r["doc_id"]: r["text"] for r in found} == want
    assert expected


def test_line_dedup_meets_once(spark):
    """Lines that share many keys are paired at one of them, whichever keys each has besides."""
    keys = {0: [*range(100, 140)], 1: [*range(100, 140)], 2: [*range(105, 145)], 3: [1, 2, *range(130, 150)]}
    rows = [(k, (i, 0, 0), 200, (0,) * len(lines.SKETCH)) for i, k in keys.items()]
    docs = spark.createDataFrame(rows, f"few array<long>, at {lines._AT}, n long, sketch {lines._SKETCH}")
    got = [(r["at"]["id"], r["to"]["id"]) for r in lines._met(lines._members(docs, "few"), 10).collect()]
    assert set(got) == {(b, a) for a in keys for b in keys if a < b}
    assert got.count((1, 0)) == got.count((2, 0)) == got.count((2, 1)) == 1
