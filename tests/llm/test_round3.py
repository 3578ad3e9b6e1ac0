"""Periodic runs, centroid clustering and SimHash groups against brute force; hot groups; token lookup."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_llm import AWKWARD, DOCS, SF, WORD
from tokenizers import Tokenizer

from tilecohort.llm import centroids, dac, langid, leaks, mil, queries, runs, simhash, substrings
from tilecohort.llm.common import hot_joined, new_path, salted


def runs_of(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= max(6, 4 * p) and not any(all(w[x] == w[x + q] for x in range(start, start + length - q)) for q in range(1, p)):
                out.append((start, length, p))
            i = i + 1 if i == start else i
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_small_alphabets():
    draw = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(draw.randint(1, 4)):
            w = [draw.randint(0, draw.randint(1, 3)) for _ in range(draw.randint(0, 50))]
            if w and draw.random() < 0.6:
                s, p = draw.randrange(len(w)), draw.randint(1, 6)
                w = [x if i < s else w[s + (i - s) % p] for i, x in enumerate(w)]
            docs.append(w)
        bounds = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        got = runs.runs_of(np.array(sum(docs, []), np.int32), bounds)
        assert got.tolist() == [[s + int(o), n, p] for d, o in zip(docs, bounds) for s, n, p in runs_of(d)]


def test_a_collision_of_hashes_is_seen(monkeypatch):
    w = np.array([i % 7 for i in range(70)] + list(range(10, 40)), np.int32)
    real, seeds = runs.windows, []

    def broken(h, size, seed):
        seeds.append(seed)
        return real(h, size, seed) if seed > 40 else np.zeros(len(h) - size + 1, np.uint64)

    monkeypatch.setattr(runs, "windows", broken)
    assert runs.runs_of(w, np.array([0, len(w)])).tolist() == [[0, 70, 7]] and seeds == [40, 41]


def test_runs_of_documents(spark):
    long = " ".join(["intro"] + [f"w{i % 500}" for i in range(60_000)])
    extra = [(20, "x " * 40_000, None, None, None), (21, long, None, None, None), (22, "a b a b a b a b a c\n\nc c c c c", None, None, None), (23, "é é\té é é é", None, None, None)]
    rows = AWKWARD + extra
    df = spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit("clash"), "collapsed": F.lit(1), "n_words": F.lit(2)})
    got = sorted((r.doc_id if r.doc_id is not None else -1, [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in runs.collapse(df).collect())
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        found = {20: [(0, 40_000, 1)], 21: [(1, 60_000, 500)], 7: [], 8: []}.get(i) if i in (7, 8, 20, 21) else runs_of(w)
        want.append((i if i is not None else -1, found, collapsed(w, found), len(w)))
    assert got == sorted(want)
    assert runs.digests(runs.collapse(df.filter("doc_id < 0"))).count() == 0


def test_periodic_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        if len(w) > 3000:
            continue
        found = runs_of(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best) and r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()


@pytest.mark.parametrize("k", [1, 2, 9, 60])
def test_tree_finds_the_nearest(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-9, 9, (k, 3))
    points[k // 2 :] = points[: k - k // 2]  # ties
    x = rng.integers(-12, 12, (500, 3))
    number, square = centroids.Tree.over(points).nearest(x)
    far = ((x[:, None, :] - points[None]) ** 2).sum(2)
    assert (number == far.argmin(1)).all() and (square == far.min(1)).all()


def kmeans(rows, k, rounds, salt):
    kept = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:k]]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, p)) for p in points] for _, v in kept]
        own = [(d.index(min(d)), min(d)) for d in far]
        if turn < rounds:
            points = [[sum(c) // len(c) for c in zip(*m)] if (m := [v for (_, v), (n, _) in zip(kept, own) if n == j]) else p for j, p in enumerate(points)]
    inertia = [sum(d for n, d in own if n == j) for j in range(len(points))]
    return sorted((str(i), n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest()) for (i, _), (n, d) in zip(kept, own))


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 64)))]
    rows += [rows[0], rows[0], (61, None), (62, [1.0] * 63), (63, [None] + [1.0] * 63), (64, [float("nan")] * 64), (65, [float("inf")] * 64), (None, [0.25] * 64), (66, [-3.0] * 64), (67, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "x": F.lit(1), "id": F.lit(2)})
    for k, part in ((8, rows), (3, rows[:2])):
        got = centroids.cluster(df if part is rows else spark.createDataFrame(part, "vec_id long, embedding array<double>"), k, 3)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got.collect()) == kmeans(part, k, 3, 3)
    assert centroids.cluster(df.filter("vec_id = 61")).count() == 0
    with pytest.raises(ValueError):
        centroids.cluster(df, 0)


def fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps):
    """doc -> smallest doc reachable by links of 4 bits or fewer."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups(spark):
    df = spark.createDataFrame(AWKWARD, DOCS).withColumns({"fp": F.lit("clash"), "n_shingles": F.lit("clash"), "component_id": F.lit(0), "key": F.lit(1)})
    got = {r.doc_id: r for r in simhash.groups(df).collect()}
    fps = {i: fingerprint(t) for i, t, *_ in AWKWARD}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    named = {i: f for i, f in fps.items() if i is not None}
    assert {i: got[i].component_id for i in named} == grouped(named) and got[None].component_id is None
    assert simhash.groups(df).count() == len(AWKWARD) and simhash.groups(df.filter("doc_id < 0")).count() == 0
    with pytest.raises(ValueError, match="different texts"):
        simhash.groups(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")).count()


def test_links_of_fingerprints_equal_all_pairs(spark, monkeypatch):
    """A tight ball, chains of four bits, pairs at four and five bits over all segments, and random ones; with few hubs, and all buckets hot or none."""
    draw = random.Random(11)
    flip = lambda f, n, among=range(64): f ^ sum(1 << b for b in draw.sample(list(among), n))
    base, fps = draw.getrandbits(64), []
    fps += [flip(base, draw.randint(0, 4)) for _ in range(120)] + [draw.getrandbits(64) for _ in range(60)]
    for _ in range(30):
        f = draw.getrandbits(64)
        fps += [f, flip(f, 4), flip(f, 5), flip(flip(f, 1, range(21)), 3, range(42, 64))]
    chain = [draw.getrandbits(64)]
    for _ in range(25):
        chain.append(flip(chain[-1], 4))
    fps = list(dict.fromkeys(fps + chain))
    draw.shuffle(fps)
    nodes = {i * 3: f for i, f in enumerate(fps)}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in nodes.items()]
    want = grouped(nodes)
    for share, hubs in ((100, 16), (10**9, 1)):
        monkeypatch.setattr(simhash, "SHARE", share)
        monkeypatch.setattr(simhash, "HUBS", hubs)
        got = {r.node: r.component for r in simhash.linked(spark.createDataFrame(signed, "doc long, fp long")).collect()}
        assert {i: got.get(i, i) for i in nodes} == want


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(1200)] + [(None, -1)], "k long, v long").cache()
    classes = rows.filter("k IS NOT NULL AND k % 7 <> 0").groupBy("k").agg(F.count("*").alias("n")).withColumn("c", F.col("k") * 2)
    for how in ("left", "inner"):
        assert sorted(map(str, hot_joined(rows, classes, ["k"], "n", how).select("k", "v", "c").collect())) == sorted(map(str, rows.join(classes, "k", how).select("k", "v", "c").collect()))
    right = classes.select("k", "c")
    assert sorted(map(str, salted(rows, right, "k").select("k", "v", "c").collect())) == sorted(map(str, rows.join(right, "k").select("k", "v", "c").collect()))


def test_tokens_are_looked_up(spark):
    low = -(1 << 63)
    texts = [(None, "first text"), (low, "one two"), (5, None), (7, "some words here"), (7, "other words"), (None, "")]
    path = new_path(spark, "shards")
    dac.write_shards(spark.createDataFrame(texts, "doc_id long, text string"), queries.VOCAB, path)
    shards = spark.read.schema(dac.SHARDS).parquet(path)
    assert not any(".snappy" in f for f in shards.inputFiles())
    assert sorted(str(r.doc_id) for r in dac.read_shards(shards).collect()) == sorted(str(i) for i, _ in texts)
    library = Tokenizer.from_file(queries.VOCAB)
    want = sorted((i, p, x) for i, t in texts if i is not None for p, x in enumerate([*library.encode(t or "", add_special_tokens=False).ids, dac.END_ID]))
    asked = spark.createDataFrame([(i, p) for i in {i for i, _ in texts} for p in range(-1, 9)] + [(99, 0), (7, None)], "doc_id long, position long")
    assert sorted(tuple(r) for r in dac.lookup(shards, asked).collect()) == want


def test_an_id_in_two_languages_teaches_both(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (2, "die katze und der hund", "de")]
    assert sorted(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == ["de", "en"]


def test_long_documents_are_learned_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["good words here"] * 300 if i % 2 else ["### $$$"] * 300)) for i in range(20)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    sizes = []
    real = mil.fit
    monkeypatch.setattr(mil, "fit", lambda x, first, label: sizes.append(np.diff(first).tolist()) or real(x, first, label))
    mil.learn(docs, labels)
    monkeypatch.setattr(mil, "TRAIN_PASSAGES", 40)
    mil.learn(docs, labels)
    assert sorted(sizes[0]) == [10] * 10 + [15] * 10 and sorted(sizes[1]) == [10] * 4 + [15] * 2


def test_basis_from_all_passages(spark):
    """More passages than any bounded sample would take: all are kept for the fit, which holds as much of them as numpy's singular vectors do."""
    rng = np.random.default_rng(6)
    topics = [rng.dirichlet(np.full(400, 0.05)) for _ in range(40)]
    texts = [" ".join(f"w{x}" for x in rng.choice(400, 96, p=topics[i % 40])) for i in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(-1, None), (-2, " ")], "doc_id long, text string")
    stats = leaks.statistics(docs).collect()
    kept = [r for r in stats if r.bag is not None]
    assert sum(len(r.sizes) for r in kept) == sum(r.n for r in stats if r.cell == -2) == 2500
    assert sum(sum(r.tf) for r in kept) == 2500 * 96
    items = spark.createDataFrame([(1, texts[0][:100])], "item_id long, text string")
    (index,) = leaks._indexes(docs, items, "item_id", "text")
    dense = np.zeros((2500, leaks.CELLS), np.float32)
    at = 0
    for r in kept:
        for row, cell, x in leaks._passages(pa.RecordBatch.from_pylist([{"bag": r.bag, "tf": r.tf, "sizes": r.sizes, "weight": 1.0}]), index.idf):
            dense[at + row, cell] = x
            at += int(row[-1]) + 1
    q = index.rows / np.where(index.idf > 0, index.idf, 1)[:, None]
    best = np.linalg.svd(dense[:, dense.any(0)], compute_uv=False)[: leaks.RANK]
    assert np.linalg.norm(dense @ q) ** 2 > 0.97 * (best**2).sum()


def test_keys_of_near_fingerprints(spark):
    """43 keys a fingerprint, and any two that differ in at most four bits share one."""
    rng = random.Random(8)
    pairs = [(a, a ^ sum(1 << b for b in rng.sample(range(64), n))) for n in range(5) for a in (rng.getrandbits(64) for _ in range(400))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long").select(simhash.variants(F.col("a")).alias("a"), simhash.variants(F.col("b")).alias("b"))
    got = rows.agg(F.min(F.size("a")), F.max(F.size("a")), F.min(F.size(F.array_intersect("a", "b")))).first()
    assert (got[0], got[1]) == (43, 43) and got[2] > 0


def test_passages_of_hot_anchors(spark):
    """A passage of nearly all documents, in a few of them with other words after it: hot anchors with hot and seldom segments."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(30)]
    texts = {}
    for d in range(1500):
        own = [f"o{rng.randrange(4000)}" for _ in range(12)]
        cut = shared[: rng.randrange(14, 30)] if d % 40 == 0 else shared
        texts[d * 3 + 1] = own[:6] + cut + own[6:]
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - 12):
            first.setdefault(tuple(texts[d][i : i + 13]), d)
    want = {}
    for d, w in texts.items():
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()} == want
