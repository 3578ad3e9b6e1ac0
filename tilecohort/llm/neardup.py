"""Near-duplicate documents: minima of many universal hashes, banding, verification, components.

Texts with equal shingle sets fall together first. Of the others, every band of
the signature is a bucket; a document of a bucket is compared with the bucket's
smallest one (first round), then with a member of another component of each of
its buckets (second). Buckets that a round has joined up drop out, so a group of
n copies costs about n comparisons, not n squared. In the last round the
documents of buckets still apart are joined on the rarest quarter of their
shingles, one of which any link must share: exact, and blind to what a group has
in common. A pair becomes a link only on its full shingle sets; the signature can
only drop pairs that are far from the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hot_joined, one_text_each, salted, written
from .components import connected
from .words import column, mix64, multipliers, slices, split, windows, word_hashes

SHINGLE = 5
#: 32 bands of 4 minima: a pair with similarity 0.75 meets in no band with probability 5e-6.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Equal minima from which a pair is compared in full: 4.7 standard deviations under what a pair at the threshold has.
AGREE = 73
#: Sets that hold a common shingle, in the last round, are more than this.
COMMON = 32
_A = (multipliers(MINIMA, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (multipliers(MINIMA, 32) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than SHINGLE words count as one shingle, no word as none."""
    w = split(texts, lower=True)
    h = word_hashes(w.vocab, seed=3)[w.codes]
    x = windows(h, SHINGLE, seed=4)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(x[a : b - SHINGLE + 1]))
        else:
            out.append(windows(h[a:b], b - a, seed=40 + b - a) if b > a else x[:0])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of MINIMA universal hashes over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        y = _A[:, None] * x[None, i : i + 2048]
        y += _B[:, None]
        np.minimum(best, y.min(1), out=best)
    return best


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (long), n_shingles, k1 and k2 (which name the shingle set) and sig of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(column(part, "text"))
            keys = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
            sig = [minima(s).tobytes() if len(s) else None for s in sets]
            cols = [column(part, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, doc): each document's BANDS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
                key = mix64((sig * multipliers(ROWS, 33)).sum(2, dtype=np.uint64) + multipliers(BANDS, 34)[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(column(batch, "doc").to_numpy(), BANDS))], names=["key", "doc"])

    return nodes.select("doc", "sig").mapInArrow(run, "key long, doc long")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough, with the number of equal minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                left, right = (np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint32).reshape(n, MINIMA) for c in ("sa", "sb"))
                same = (left == right).sum(1)
                out = pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(same.astype(np.int32))], names=["a", "b", "same"])
                yield out.filter(pa.array(same >= AGREE))

    sig = nodes.select("doc", "sig")
    # the signature of a bucket's hub goes to its many pairs in copies
    full = salted(pairs, sig.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a")
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, same int")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= 75 * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "xa"), column(batch, "xb")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    full = salted(pairs.select("a", "b"), sets.select(F.col("doc").alias("b"), F.col("x").alias("xb")), "b").join(sets.select(F.col("doc").alias("a"), F.col("x").alias("xa")), "a")
    return full.select("a", "b", "xa", "xb").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, n: int | None = None) -> DataFrame:
    """The links among pairs, written; with n, of each a only the n pairs whose signatures agree most are compared in full."""
    asked = written(pairs, "pairs")
    alike = _alike(asked, nodes)
    near = written(_best(alike, n) if n else alike.select("a", "b"), "pairs")
    links = written(_links(near, sets), "links")
    discard(asked)
    discard(near)
    return links


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, x): the full shingle sets of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(part, "doc"), pa.array([s.tobytes() for s in shingle_sets(column(part, "text"))], pa.binary())], names=["doc", "x"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).join(wanted.select("doc"), "doc", "left_semi")
    return rows.mapInArrow(run, "doc long, x binary")


def _best(alike: DataFrame, n: int) -> DataFrame:
    """Of each a, the n pairs whose signatures agree most."""
    order = Window.partitionBy("a").orderBy(F.desc("same"), F.xxhash64("a", "b"))
    return alike.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("a", "b")


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share one of the rarest shingles of both.

    Of two sets with similarity 0.75 or more, each holds at most a quarter outside the other, so the
    first floor(n / 4) + 1 shingles of each in one common order, rarest first, meet. Take the first
    shingle they meet in. What they share is at most what each shares with anyone, and if that shingle
    is in over COMMON sets, at most what each has of such shingles, for the rarer ones came before; it is
    at most what each has from that shingle on; and
    it must be 3/7 of their sizes' sum. So a common shingle joins only sets nearly all of common ones,
    which are of one component already. The largest component of a shingle isn't paired with itself.
    """
    docs = rest.select("doc", "c").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(s.as_buffer(), np.int64) for s in column(batch, "x")]
            n = np.array([len(s) for s in x], np.int64)
            for i in range(0, len(x), 500):
                m = n[i : i + 500]
                take = pa.array(np.repeat(np.arange(i, i + len(m)), m))
                yield pa.RecordBatch.from_arrays([column(batch, "doc").take(take), column(batch, "c").take(take), pa.array(np.repeat(m, m)), pa.array(np.concatenate(x[i : i + 500]))], names=["doc", "c", "n", "g"])

    rows = sets.join(docs, "doc").select("doc", "c", "x").mapInArrow(run, "doc long, c long, n long, g long")
    counted = rows.join(rows.groupBy("g").agg(F.count("*").alias("df")), "g")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("df", "g"))
    own = Window.partitionBy("doc")
    most = F.when(F.col("df") > COMMON, F.count_if(F.col("df") > COMMON).over(own)).otherwise(F.count_if(F.col("df") > 1).over(own))
    kept = counted.withColumn("r", rank).withColumn("s", most).filter("df > 1 AND r <= floor(n / 4) + 1 AND 4 * s >= 3 * n")
    rare = written(kept.select("g", "doc", "c", "n", "s", "r"), "rare")
    sizes = rare.groupBy("g", "c").agg(F.count("*").alias("n"))
    major = sizes.groupBy("g").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("g", F.col("m.c").alias("most"))
    minor = rare.join(major, "g").filter("c <> most")
    left = rare.select("g", F.col("doc").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("r").alias("ra"))
    right = minor.select("g", F.col("doc").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("r").alias("rb"))
    return left.join(right, "g").filter("ca <> cb AND 7 * least(sa, sb, na - ra + 1, nb - rb + 1) >= 3 * (na + nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of near-duplicate documents.

    Returns doc_id (long), n_shingles, component_id (the smallest doc_id reachable, itself included) and
    kept (doc_id = component_id), a row for each input row. A text that is null or has no word has no
    shingle and is linked with nothing; rows that repeat a doc_id and its shingles are one document, and with different shingles raise; a null doc_id is
    linked with nothing and kept, with a null component. Other columns are not read.
    """
    rows = written(sketches(docs, doc_id, text), "sketches")
    one_text_each(rows, "doc_id", "n_shingles", "k1", "k2")
    real = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.count("*").alias("n")), "nodes")
    keys = band_keys(nodes)
    hubs = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("top")).filter("hub < top")
    live = written(keys.join(hubs, "key").select("key", "doc", "hub"), "buckets")
    sets = written(_sets(docs, live.select("doc").distinct(), doc_id, text).dropDuplicates(["doc"]), "sets")

    first = live.filter("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    links = _verified(first, nodes, sets, 2)
    same = written(connected(links), "components")

    # second round: each document against a member of another component of its bucket
    members = written(_members(live, same), "members")
    hashed = members.groupBy("key", "c").agg(F.min(F.struct(F.xxhash64("key", "doc").alias("h"), "doc")).alias("m"))
    ends = hashed.groupBy("key").agg(F.min(F.struct("c", "m.doc")).alias("low"), F.max(F.struct("c", "m.doc")).alias("high"))
    second = members.join(ends, "key").select(F.col("doc").alias("a"), F.when(F.col("c") == F.col("low.c"), F.col("high.doc")).otherwise(F.col("low.doc")).alias("b")).distinct()
    more = _verified(second, nodes, sets, 4)
    same = written(connected(_joined(same, more)), "components")

    # last round: what is still apart within a bucket
    rest = written(_members(members.select("key", "doc"), same), "members")
    last = _verified(_across(rest, sets), nodes, sets)
    same = written(connected(_joined(same, last)), "components")

    named = nodes.select("k1", "k2", "doc", "n").join(same.select(F.col("node").alias("doc"), "component"), "doc", "left").select("k1", "k2", "n", F.coalesce("component", "doc").alias("component"))
    is_real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    slim = rows.select("doc_id", "n_shingles", "k1", "k2")
    # equal texts meet their component where they are, and texts without a word need none
    found = hot_joined(slim.filter(is_real), written(named, "classes"), ["k1", "k2"], "n").select("doc_id", "n_shingles", "component").unionByName(slim.filter(~is_real).select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.col("component")
    for table in (live, sets, links, members, more, rest, last):
        discard(table)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _members(live: DataFrame, same: DataFrame) -> DataFrame:
    """(key, doc, c) of the buckets whose documents aren't all of one component."""
    held = live.select("key", "doc").join(same.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))
    apart = held.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    return held.join(apart, "key", "left_semi")


def _joined(same: DataFrame, links: DataFrame) -> DataFrame:
    """The edges of earlier components and new links."""
    return same.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)
