"""Substring removal by seed and extend, exact for windows of WINDOW words.

Every window of WINDOW words holds an anchor: its least k-gram of K words by hash
(winnowing), so equal windows hold equal anchors at equal places. Successive
windows with one anchor form a segment. Documents join on anchors; those joined
are extended both ways:

1. Where a whole segment (anchor and all words around it) also stands in a smaller
   document, all its windows go.
2. Where an anchor has several different segments, the first document of each
   compares single windows.

The runs of windows found make up the maximal repeats. A group of n copies costs n rows, not n squared pairs,
and no group is gathered in one task: groups are only aggregated (minimum document) and joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, discard, hot_joined, one_text_each, written
from .words import column, inside, mix64, multipliers, slices, split, windows, word_hashes

WINDOW = 13
K = 5
#: Tasks that the rows of a hot segment are dealt out to.
PIECES = 64
_FOUND = "h long, s long, doc long, pos long, n_words long, sha string"
_SECOND = "doc long, w1 long, w2 int, pos long, n_words long, n_removed long, sha string"


def segments(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, segment hash, first window, windows) of every segment of a slice; windows are numbered by their first word."""
    n = len(h) - WINDOW + 1
    ok = inside(bounds, WINDOW)
    if not ok.any():
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = windows(h, K, seed=12)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - K + 1):
        low = grams[j : j + n] <= best
        best[low] = grams[j : j + n][low]
        at[low] = j
    at += np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    new &= ok
    first = np.flatnonzero(new)
    # a segment ends before the next one or at the last window of its text
    stop = np.append(first[1:], n)
    last_ok = np.flatnonzero(ok & np.append(~ok[1:], True)) + 1
    count = np.minimum(stop, last_ok[np.searchsorted(last_ok, first, side="right")]) - first
    size = count + WINDOW - 1
    total = (size.astype(np.uint64) << np.uint64(8)) + (at[first] - first).astype(np.uint64)
    for j, m in enumerate(multipliers(int(size.max()), 13)):
        live = np.flatnonzero(size > j) if j >= WINDOW else slice(None)
        total[live] += h[first[live] + j] * m
    return grams[at[first]], mix64(total), first, count


def _kept_sha(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])).hexdigest()


def _anchors(docs: DataFrame) -> DataFrame:
    """A row for each segment, and one with n_words and the digest of all words for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = split(column(part, "text"))
            ids = column(part, "doc")
            anchor, segment, first, count = segments(word_hashes(w.vocab, seed=11)[w.codes], w.bounds)
            doc = np.searchsorted(w.bounds, first, side="right") - 1
            view = memoryview(w.data)
            sha = [_kept_sha(view, w.starts[a:b], w.ends[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
            n, m = len(first), len(sha)
            none = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), ids.take(pa.array(doc)), pa.array((first - w.bounds[doc]) << 4 | count), none(n, pa.int64()), none(n, pa.string())], schema=_arrow)
            yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.int64()), ids, none(m, pa.int64()), pa.array(np.diff(w.bounds)), pa.array(sha, pa.string())], schema=_arrow)

    _arrow = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
    return docs.mapInArrow(run, _FOUND)


def _spread(packed: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the packed runs of windows cover."""
    first, count = packed >> 4, packed & 15
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(first, n), 1)
    np.add.at(edge, np.minimum(first + count + WINDOW - 1, n), -1)
    return np.cumsum(edge)[:n] > 0


def _second(docs: DataFrame) -> DataFrame:
    """Of documents with ``cut`` (runs to remove) and ``ask`` (segments to compare by window): the windows asked for, or else the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("doc", pa.int64()), ("w1", pa.int64()), ("w2", pa.int32()), ("pos", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string())])

        def rows(n: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in fields], schema=fields)

        for part in slices(batches, "text"):
            w = split(column(part, "text"))
            ids, cuts, asks = column(part, "doc").to_numpy(zero_copy_only=False), column(part, "cut"), column(part, "ask")
            h = word_hashes(w.vocab, seed=11)[w.codes]
            one, two = windows(h, WINDOW, seed=14), windows(h, WINDOW, seed=15)
            asked = [np.asarray(a.values) if a.is_valid and len(a) else np.zeros(0, np.int64) for a in asks]
            which = np.flatnonzero([len(a) > 0 for a in asked])
            if len(which):
                doc, packed = np.repeat(which, [len(asked[d]) for d in which]), np.concatenate([asked[d] for d in which])
                count = packed & 15
                doc, pos = np.repeat(doc, count), np.repeat(packed >> 4, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = w.bounds[doc] + pos
                ok = at + WINDOW <= w.bounds[doc + 1]
                doc, pos, at = doc[ok], pos[ok], at[ok]
                yield rows(len(at), doc=pa.array(ids[doc]), w1=pa.array(one[at].view(np.int64)), w2=pa.array((two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pos=pa.array(pos))
            rest = np.setdiff1d(np.arange(part.num_rows), which)
            if len(rest):
                yield rows(len(rest), **_result(w, ids, cuts, rest))

    return docs.select("doc", "text", "cut", "ask").mapInArrow(run, _SECOND)


def _result(w, ids: np.ndarray, cuts: pa.Array, rows: np.ndarray) -> dict[str, pa.Array]:
    n, removed, sha = [], [], []
    view = memoryview(w.data)
    for d in rows.tolist():
        a, b = int(w.bounds[d]), int(w.bounds[d + 1])
        cut = np.asarray(cuts[d].values) if cuts[d].is_valid else np.zeros(0, np.int64)
        gone = _spread(cut, b - a)
        n.append(b - a)
        removed.append(int(gone.sum()))
        sha.append(_kept_sha(view, w.starts[a:b][~gone], w.ends[a:b][~gone]))
    return {"doc": pa.array(ids[rows]), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "sha": pa.array(sha, pa.string())}


def _last(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            got = _result(split(column(part, "text")), column(part, "doc").to_numpy(zero_copy_only=False), column(part, "cut"), np.arange(part.num_rows))
            yield pa.RecordBatch.from_arrays(list(got.values()), names=list(got))

    return docs.select("doc", "text", "cut").mapInArrow(run, "doc long, n_words long, n_removed long, sha string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each word covered by a window of WINDOW words that also starts in a document with a smaller id.

    Returns doc_id (long), n_words, n_removed and kept_sha256 of each document. Windows are judged on the
    input. A null text has no words. Rows that repeat a doc_id and its text give one row each, and with
    different texts raise; a null doc_id is a document of its own that neither removes nor loses words. Other columns aren't read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    named = source.filter("doc IS NOT NULL")
    found = written(_anchors(source), "anchors")
    at = found.filter("h IS NOT NULL AND doc IS NOT NULL").select("h", "s", "doc", "pos")
    whole = written(found.filter("h IS NULL").select("doc", "n_words", "sha"), "whole")
    one_text_each(whole, "doc", "n_words", "sha")
    # frequent anchors: with a thousandth of a sample of documents' rows or more, so a thousand at most; this only decides how rows meet
    some = at.filter(F.pmod(F.xxhash64("doc"), F.lit(64)) == 0)
    hot = written(some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") * 1000 > some.count()).select("h"), "hot")
    # hot anchors are summed up by segment; what is known of them and of their hot segments, a thousand at most each, goes to the rows
    # (other anchors' rows are one group there, combined where they are)
    often = at.join(F.broadcast(hot.withColumn("often", F.lit(True))), "h", "left").groupBy(*[F.when(F.col("often"), F.col(c)).alias(c) for c in ("h", "s")])
    every = written(often.agg(F.min("doc").alias("known"), F.max("doc").alias("b"), F.count("*").alias("n")), "segments")
    sums = every.filter("h IS NOT NULL")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    anchors = sums.groupBy("h").agg(((F.min("s") == F.max("s")) | (F.min("known") == F.max("b"))).alias("alone"))
    segments_ = sums.filter(F.col("n") * HOT > F.lit(int(total))).select("h", "s", "known")
    rows = at.join(F.broadcast(anchors), "h", "left").join(F.broadcast(segments_), ["h", "s"], "left")
    # rows are dealt out once, by anchor, those of hot anchors by segment and those of hot segments by document;
    # windows over segment and anchor need no further move
    dealt = rows.withColumn("part", F.when(F.col("alone").isNull(), 0).when(F.col("known").isNotNull(), F.pmod(F.xxhash64("doc"), F.lit(PIECES))).otherwise(F.col("s")))
    segment, anchor = Window.partitionBy("h", "part", "s"), Window.partitionBy("h", "part")
    alone = (F.min("s").over(anchor) == F.max("s").over(anchor)) | (F.min("doc").over(anchor) == F.max("doc").over(anchor))
    placed = dealt.withColumn("first", F.coalesce("known", F.min("doc").over(segment))).withColumn("one", F.coalesce("alone", alone))
    marked = placed.filter("doc > first OR NOT one").select("doc", "pos", "first", "one")
    runs = lambda of: F.collect_list(F.when(of, F.col("pos")))
    todo = written(marked.groupBy("doc").agg(runs(F.col("doc") > F.col("first")).alias("cut"), runs((F.col("doc") == F.col("first")) & ~F.col("one")).alias("ask")).filter("size(cut) + size(ask) > 0"), "todo")
    for table in (found, every, hot):
        discard(table)
    texts = named.join(todo, "doc").dropDuplicates(["doc"])
    step = written(_second(texts), "step")

    asked = step.filter("w1 IS NOT NULL").select("w1", "w2", "doc", "pos")
    origin = written(asked.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("b"), F.count("*").alias("n")).filter("first < b").select("w1", "w2", "first", "n"), "origin")
    more = hot_joined(asked, origin, ["w1", "w2"], "n", "inner").filter("doc > first").groupBy("doc").agg(F.collect_list(F.shiftleft("pos", 4).bitwiseOR(F.lit(1))).alias("more"))
    # texts that asked are read again; keeping them would write them once more
    going = named.join(todo.filter(F.size("ask") > 0).join(more, "doc", "left"), "doc").dropDuplicates(["doc"])
    late = _last(going.select("doc", "text", F.concat("cut", F.coalesce("more", F.array().cast("array<long>"))).alias("cut")))
    early = step.filter("w1 IS NULL").select("doc", "n_words", "n_removed", "sha")
    changed = early.unionByName(late).select("doc", "n_removed", F.col("sha").alias("new"))
    return whole.join(changed, "doc", "left").select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256"))
