import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from test_text_operators import SPACE, expected_lines

import corpus_pipeline
from netloom.llm import embed, minhash, mixing, queries, toxicity, warc
from netloom.operators.components import components
from netloom.store import Store


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, store, one_task):
    random.seed(5)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)]
    up = Union()
    for a, b in pairs:
        if a != b:
            up.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), store, "c", one_task).collect()}
    assert got == {x: up.find(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long"), store, "none", one_task).count() == 0


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in SPACE.split(low) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def expected_groups(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    at, up = {}, Union()
    for i in sorted(sets):
        for s in sets[i]:
            at.setdefault(s, []).append(i)
    for i, s in sets.items():
        seen = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up.join(i, j)
    return {i: (len(s), up.find(i), up.find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(store, documents, texts, width):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(documents, store, width).collect()}
    assert got == expected_groups(texts, width, 80)
    assert any(not v[2] for v in got.values())


@pytest.mark.parametrize("how", [{}, {"crowd": 0, "block": 16}])
def test_minhash_chains_and_large_groups(spark, store, how):
    random.seed(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):  # copies of copies: many pairs lie near the bound, and links run through third documents
        w = list(base)
        for _ in range(random.randint(0, 9)):
            w[random.randrange(120)] = f"x{random.randint(0, 500)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs, store, **how).collect()}
    assert got == expected_groups(dict(rows), 2, 80)


def test_minhash_awkward(spark, store, awkward, empty):
    rows = minhash.near_duplicates(awkward, store).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in rows)
    assert [g[:1] + g[2:] for g in got if g[0]] == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 7, True)]
    assert minhash.near_duplicates(empty, Store(spark, "t")).count() == 0
    left = minhash.deduplicated(awkward, Store(spark, "t"), 2)
    assert left.columns == awkward.columns and left.count() == 8


def test_odd_sketches_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) for n in (850, 75, 75))
    one, two = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    _, odd = minhash.signatures(np.concatenate([one, two]), np.array([len(one), len(two)]), minhash.BANDS, minhash.ROWS, minhash.SKETCH_WORDS)
    bits = minhash.SKETCH_WORDS * 64
    z = int(np.unpackbits((odd[0] ^ odd[1]).view(np.uint8)).sum())
    estimate = 1 - (-bits / 2 * math.log(1 - 2 * z / bits)) / (2 * minhash.BANDS * minhash.ROWS)
    assert abs(estimate - 0.85) < 0.1


def expected_vectors(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up, links = Union(), {}
    unit = np.array([v / np.sqrt((v * v).sum()) for _, v in good])
    near = unit @ unit.T >= cosine
    for a in range(len(good)):
        links[good[a][0]] = int(near[a].sum()) - 1
        for b in np.flatnonzero(near[a]):
            up.join(good[a][0], good[b][0])
    return {i: (links.get(i, 0), up.find(i), up.find(i) == i) for i, _ in rows}


@pytest.mark.parametrize("block,lists", [(embed.BLOCK, None), (40, 6)])
def test_near_vectors(spark, store, sf_dir, block, lists):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = {r["vec_id"]: tuple(r)[1:] for r in embed.near_vectors(vectors, store, block=block, lists=lists).collect()}
    assert got == expected_vectors(rows)


def test_near_vectors_awkward(spark, store):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], None), (3, None, "a"), (4, [], "a"), (5, [0.0, 0.0], "a"), (6, [nan, 1.0], "a"), (7, [None, 1.0], "a"), (8, [1.0, 0.1], "a"), (9, [1.0, 0.0, 0.0], "a"), (10, [0.0, 1.0], "a"), (11, [float("inf"), 1.0], "a")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embed.near_vectors(docs, store).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[8] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11))
    assert embed.near_vectors(docs.limit(0), Store(spark, "t")).count() == 0


def expected_records(rows):
    payload = {i: (h or "").encode() for i, h in rows}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    out = {}
    for i, b in payload.items():
        target = first[b] if len(b) >= warc.LEAST_REVISIT and first[b] != i else None
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if target is not None else "response", target)
    return out


def test_warc_query(spark, sf_dir):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op5_warc(spark, sf_dir).collect()}
    assert got == expected_records(rows)


def test_warc_awkward_and_files(spark, store):
    page = "<p>" + "same" * 50 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a\r\nX: y", page, 1), (2, None, page, 1), (3, "u", "short", 1), (4, "u", "short", 1), (5, None, None, None), (6, "u", "é" * 70000, 2), (7, "u", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int")
    out = warc.archive_pages(pages, store, file_bytes=1000).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out} == expected_records([r[::2][:2] for r in rows])
    for path in {r["archive"] for r in out}:
        with fs.LocalFileSystem().open_input_stream(path, compression=None) as stream:
            raw = stream.read()
        found, at = [], 0
        while at < len(raw):  # every member stands alone
            engine = zlib.decompressobj(31)
            found.append(engine.decompress(raw[at:]))
            at = len(raw) - len(engine.unused_data)
        members = sorted(r["member_offset"] for r in out if r["archive"] == path)
        assert len(found) == len(members) and members[0] == 0
    assert warc.archive_pages(pages.limit(0), Store(spark, "t")).count() == 0


def test_warc_normaliser_reads_pieces_and_rejects_broken_streams():
    records = [warc.record({"WARC-Type": "response", "n": str(i)}, b"x" * i) for i in (0, 1, 5000)]
    stream = zlib.compress(b"".join(records), wbits=31)
    parser = warc.Parser()
    pieces = [stream[i : i + 7] for i in range(0, len(stream), 7)]
    got = [raw for piece in warc.inflate(iter(pieces)) for _, _, raw in parser.feed(piece)]
    parser.close()
    assert got == records
    broken = warc.Parser()
    list(broken.feed(records[2][:100]))
    with pytest.raises(ValueError):
        broken.close()


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def weights_at(tokens, t):
    raised = [(x / sum(tokens)) ** t if x else 0.0 for x in tokens]
    return [x / sum(raised) for x in raised]


def bisected(tokens, target_entropy=None, repetition_limit=None, sharpen=False):
    some = [x for x in tokens if x]
    if target_entropy is not None:
        over = lambda t: entropy(weights_at(some, t)) < target_entropy * math.log(len(some))
    else:
        over = lambda t: max(w * sum(some) / x for w, x in zip(weights_at(some, t), some, strict=True)) <= repetition_limit
    low, high = 0.0, 64.0 if sharpen else 1.0
    if not over(high):
        return high
    for _ in range(60):
        low, high = (low, (low + high) / 2) if over((low + high) / 2) else ((low + high) / 2, high)
    return round(high, 9)


def test_warc_cut_short(spark, store, tmp_path):
    """A stream that ends early raises, even between records, as does one with another number of records than was written."""
    records = [warc.record({"warc-TYPE": "response", "WARC-Page-ID": str(i)}, b"x" * 50) for i in range(3)]
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    early = engine.compress(records[0]) + engine.flush(zlib.Z_FULL_FLUSH)
    with pytest.raises(ValueError, match="ends early"):
        list(warc.inflate(iter([early])))
    path = f"{tmp_path}/a.warc.gz"
    with open(path, "wb") as out:
        out.write(zlib.compress(b"".join(records), wbits=31))
    archives = lambda n: spark.createDataFrame([(path, n)], "path string, records long")
    assert warc.normalise(archives(3), f"file://{tmp_path}/out").collect()[0]["records"] == 3
    assert warc.normalise(archives(3).select("path"), f"file://{tmp_path}/out").collect()[0]["records"] == 3
    with pytest.raises(Exception, match="records instead of 4"):
        warc.normalise(archives(4), f"file://{tmp_path}/out").collect()


def test_warc_records_are_whole(spark, store):
    """Dates, HTTP heads, and what a revisit refers to."""
    pages = spark.createDataFrame([(1, "http://a", "x" * 200), (2, "http://b", "x" * 200)], "page_id long, url string, html string").coalesce(1)
    (path,) = {r["archive"] for r in warc.archive_pages(pages, store, date="2020-01-02T03:04:05Z").collect()}
    with fs.LocalFileSystem().open_input_stream(path, compression=None) as stream:
        found = [x for piece in warc.inflate(iter([stream.read()])) for x in warc.Parser().feed(piece)]
    by = {head["warc-page-id"]: (head, block) for head, block, _ in found}
    assert all(head["warc-date"] == "2020-01-02T03:04:05Z" and head["content-type"] == "application/http; msgtype=response" for head, _ in by.values())
    assert by["1"][1] == warc.http_head(200) + b"x" * 200 and by["2"][1] == warc.http_head(200)
    assert by["2"][0]["warc-refers-to-target-uri"] == "http://a" and by["2"][0]["warc-refers-to-date"] == "2020-01-02T03:04:05Z"


def test_mixing_exponents(spark):
    sources = lambda tokens: spark.createDataFrame([(x,) for x in tokens], "tokens long")
    tokens = [900, 50, 40, 10, 0]
    for how in ({"target_entropy": 0.9}, {"repetition_limit": 2.0}, {"target_entropy": 0.1, "sharpen": True}, {"target_entropy": 0.3}):
        assert abs(mixing.exponent(sources(tokens), **how) - bisected(tokens, **how)) < 2e-9, how
    assert abs(entropy(weights_at(tokens[:4], mixing.exponent(sources(tokens), target_entropy=0.9))) - 0.9 * math.log(4)) < 1e-8
    assert mixing.exponent(sources([5]), target_entropy=0.9) == 1.0 and mixing.exponent(sources([5, 5]), target_entropy=0.9) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent(sources(tokens))


def h(*parts):
    return int(hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16)


def expected_copies(rows, seed=17, block_rows=mixing.BLOCK_ROWS, cover=False, **how):
    words = {i: len([w for w in SPACE.split(t or "") if w]) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by.setdefault("null" if s is None else "=" + s, []).append(i)
    names = sorted(by)
    tokens = [sum(words[i] for i in by[s]) for s in names]
    weights = [round(w, 12) for w in weights_at(tokens, bisected(tokens, **how))]
    budget = max(math.ceil(n / w) for n, w in zip(tokens, weights, strict=True) if w) if cover else sum(tokens)
    out = {}
    for s, n, w in zip(names, tokens, weights, strict=True):
        passes, rest = divmod(math.floor(w * budget + 0.5), n) if n else (1, 0)
        if cover and not passes:
            passes, rest = 1, 0
        count = -(-len(by[s]) // block_rows)
        blocks = {}
        for i in by[s]:
            blocks.setdefault(h(seed, i) % count, []).append(i)
        for b in sorted(blocks, key=lambda b: (h(seed, s, b), b)):
            total = sum(words[i] for i in blocks[b])
            if rest <= 0:
                taken = set()
            elif total <= rest:
                taken = set(blocks[b])
            else:
                taken, run = set(), 0
                for i in sorted(blocks[b], key=lambda i: h(seed, i)):
                    run += words[i]
                    if run > rest:
                        break
                    taken.add(i)
            rest -= total
            for i in blocks[b]:
                out[i] = passes + (i in taken)
    return out


@pytest.mark.parametrize("how", [{"target_entropy": 0.99}, {"repetition_limit": 1.5}, {"target_entropy": 0.995, "cover": True}, {"target_entropy": 0.7, "sharpen": True}])
def test_mixing_copies(spark, store, documents, how):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    got = {r["doc_id"]: r["copies"] for r in mixing.plan(documents, store, block_rows=8, **how).select("row.doc_id", "copies").collect()}
    assert got == expected_copies(rows, block_rows=8, **how)
    assert len(set(got.values())) > 1
    if how.get("cover"):
        assert min(got.values()) >= 1


def test_mixing_awkward(spark, store, awkward, empty):
    out = mixing.plan(awkward, store, target_entropy=0.5, cover=True).collect()
    assert len(out) == 9 and min(r["copies"] for r in out) >= 1
    assert mixing.mixed(awkward, Store(spark, "t"), target_entropy=0.9).columns == awkward.columns
    assert mixing.mixed(empty, Store(spark, "t"), target_entropy=0.9).count() == 0


def test_mixing_query_mixes(spark, sf_dir):
    """Copies differ, and the words that each source is read for follow its weight as closely as one block's last document allows."""
    rows = queries.op8_temperature_mixing(spark, sf_dir).collect()
    assert len({r["copies"] for r in rows}) > 1
    every, longest = sum(r["n_words"] for r in rows), max(r["n_words"] for r in rows)
    for s in {r["source"] for r in rows}:
        of = [r for r in rows if r["source"] == s]
        assert abs(sum(r["n_words"] * r["copies"] for r in of) - of[0]["weight"] * every) <= longest


def test_mixing_uses_no_python(spark, documents):
    plan = mixing.plan(documents, Store(spark, "t"), target_entropy=0.9)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_toxicity(spark, sf_dir, awkward, empty):
    larger = sf_dir.replace("sf0.001", "sf0.1")
    rows = queries.op9_toxicity(spark, larger).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    tp, fp, fn = (sum(j == k for j in judged) for k in ((1, 1), (1, 0), (0, 1)))
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.7, (tp, fp, fn, len(judged))
    few = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.toxicity(awkward, few, Store(spark, "t")).count() == 9
    assert toxicity.toxicity(empty, few, Store(spark, "t")).count() == 0
    assert {r["score"] for r in toxicity.toxicity(awkward, few.limit(0), Store(spark, "t")).collect()} == {0.0}
    assert toxicity.without_toxic(awkward, few.limit(0), Store(spark, "t")).columns == awkward.columns


def test_toxicity_of_small_tables(spark, sf_dir):
    """Too few labels for any feature to tell: every row still gets a score."""
    assert queries.op9_toxicity(spark, sf_dir).where("score between 0 and 1").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    docs = spark.createDataFrame([(i, "some words" if i % 3 else None) for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < 4)) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels, Store(spark, "t")).where("score between 0 and 1").count() == 8


def test_fit_by_brute_force():
    """The same steps with dense loops and the gradient by finite differences, through the part where the unlabelled risk is clipped."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    row = lambda toxic: sorted({*rng.choice(6, 2).tolist(), *([6] if toxic else [])})
    p, u, prior, decay, steps = [row(True) for _ in range(12)], [row(i % 4 == 0) for i in range(30)], 0.4, 0.3, 60
    got = toxicity.fit(toxicity.Rows(pa.array(p)), toxicity.Rows(pa.array(u)), np.arange(7), prior, steps=steps, decay=decay)
    loss = lambda w, rows, y: sum(math.log1p(math.exp(-y * (sum(w[f] for f in r) + w[-1]))) for r in rows) / len(rows)
    unlabelled = lambda w: loss(w, u, -1) - prior * loss(w, p, -1)
    w, mean, square, clipped = np.zeros(8), np.zeros(8), np.zeros(8), 0
    w[-1] = math.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        low = unlabelled(w) < 0
        clipped += low
        goal = (lambda v: -unlabelled(v)) if low else (lambda v: prior * loss(v, p, 1) + unlabelled(v))
        g = np.array([(goal(w + e) - goal(w - e)) / 2e-5 for e in np.eye(8) * 1e-5])
        g[:-1] += decay / len(p) * w[:-1]
        mean, square = mean + 0.1 * (g - mean), square + 0.001 * (g * g - square)
        w = w - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(got[[*range(7), -1]], w, atol=1e-4), (got[:7], w)
    assert 0 < clipped < steps


def test_risk_is_never_negative_and_learns():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    row = lambda toxic: sorted({*rng.integers(100, 5000, 40).tolist(), *([7, 8] if toxic else [])})
    positive = toxicity.Rows(pa.array([row(True) for _ in range(150)]))
    unlabelled = toxicity.Rows(pa.array([row(i % 10 == 0) for i in range(800)]))
    counts = [np.bincount(r.index, minlength=1 << toxicity.BITS) for r in (positive, unlabelled)]
    w = toxicity.fit(positive, unlabelled, toxicity.telling(*counts, 150, 800), 0.1)
    z = lambda f: w[f].sum() + w[-1]
    assert np.mean([z(row(True)) > 0 for _ in range(200)]) > 0.95 and np.mean([z(row(False)) < 0 for _ in range(200)]) > 0.95


def test_pipeline(spark, sf_dir, documents, store):
    """Every stage against brute force on what the stage before it kept."""
    columns, labels = documents.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept, docs = [], documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = [tuple(r) for r in docs.select("doc_id", F.coalesce("text", F.lit("")), "source").collect()]
        if i == 0:
            good = {r["doc_id"] for r in toxicity.toxicity(docs, labels, Store(spark, "t")).where("predicted = 0").collect()}
            expected = [(d, t) for d, t, _ in before if d in good]
        elif i == 1:
            gone = expected_lines([(d, t) for d, t, _ in before])
            left = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())), d in gone) for d, t, _ in before]
            expected = [(d, t) for d, t, lost in left if not lost or SPACE.sub("", t)]
        elif i == 2:
            groups = expected_groups({d: t for d, t, _ in before}, 5, 80)
            expected = [(d, t) for d, t, _ in before if groups[d][2]]
        else:
            copies = expected_copies([(d, t, s) for d, t, s in before], target_entropy=0.9, cover=True)
            expected = [(d, t) for d, t, _ in before for _ in range(copies[d])]
        docs = store.cut(stage(spark, docs, sf_dir), f"p{i}")
        assert docs.columns == columns
        rows = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]
        assert sorted(rows) == sorted(expected), i
        kept.append(len(rows))
    assert kept[0] >= kept[1] >= kept[2] <= kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = [(r["sequence_id"], r["offset"], r["length"]) for r in packed.collect()]
    ends = {}
    for q, offset, n in sorted(rows):
        assert offset == ends.get(q, 0) and 0 < n <= 1024
        ends[q] = offset + n
        assert ends[q] <= 1024
    assert packed.where("piece = 0").count() == docs.count()


def test_pipeline_of_nothing(spark, sf_dir, documents):
    """Each stage of an empty table is empty."""
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), sf_dir).count() == 0, name
