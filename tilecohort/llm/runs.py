"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a document fall into classes by their first l words. With l going
down, classes are united (union-find over ordered sets of positions, the smaller
set into the larger), along the edges that neighbours in the order of suffixes
form, weighted by their longest common prefix (LCP). Two positions at distance d
that become neighbours in a class at LCP l, with l at least d, seed the run with
period d that ends l words after the second: any position in between with as long
a common prefix would have been a neighbour sooner, so d is the smallest period.
The leftmost seed of each (period, end) is where the run begins.

A run that counts repeats its period LEAST times or more, so its seed has an LCP of (LEAST - 1) d
and of GRAM words at least. So suffixes begin as classes of equal GRAM-word windows,
refined by doubling, and positions whose longest common prefix is too short for
their nearest equal window never enter a set.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column, inside, joined, mix64, slices, split, windows

#: A run has SHORTEST words and LEAST periods at least.
SHORTEST, LEAST = 6, 4
#: The least common prefix of a seed: SHORTEST - 1 words at period 1, and (LEAST - 1) d beyond.
GRAM = 5
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def suffix_classes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first, order, levels) by prefix doubling.

    ``first`` sorts positions by their character, then place; ``order`` sorts all suffixes of repeated characters so that those with equal
    beginnings stand together; ``levels[k]`` numbers the classes of 2**k characters. The last character of each text must be unique.
    """
    order = first = np.argsort(chars, kind="stable")
    new = np.ones(len(chars), bool)
    new[1:] = chars[order[1:]] != chars[order[:-1]]
    slots, rank, levels = np.arange(len(chars)), np.empty(len(chars), np.int32), []
    active, order, step = order, order.copy(), 1
    while True:
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank = rank.copy()
        rank[active] = slots[begin]
        levels.append(rank)
        many = ~(new & np.append(new[1:], True))
        active, slots = active[many], slots[many]
        if not len(active):
            return first, order, levels
        key = rank[active].astype(np.int64) << 32 | rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[slots] = active
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        step *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Characters that the suffixes at a and b have in common."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        a, b, total = a + step, b + step, total + step
    return total


def _seeds(at: list[int], edges: Iterator[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """(period, end) -> start of the runs. ``at``: positions in the order of suffixes; an edge (l, s) joins the s-th and the next one."""
    parent, sets, found = list(range(len(at))), [[p] for p in at], {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def adjacent(i: int, j: int, l: int) -> None:
        d = j - i
        if (LEAST - 1) * d <= l and l + d >= SHORTEST:
            key = (d, j + l)
            if found.get(key, j) > i:
                found[key] = i

    for l, s in edges:
        a, b = root(s), root(s + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b] = a, None
        last = len(small) - 1
        for n, x in enumerate(small):
            k = bisect_left(large, x)
            if k and (not n or large[k - 1] != small[n - 1]):
                adjacent(large[k - 1], x, l)
            if k < len(large) and (n == last or small[n + 1] > large[k]):
                adjacent(x, large[k], l)
            large.insert(k, x)
    return found


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of texts given as word codes, by start, then period; starts are counted over all texts.

    Windows are told apart by 64-bit hashes; every run found is compared word by word, and if one fails, hashes of another seed serve.
    """
    for seed in range(40, 60):
        found = _runs(codes, bounds, seed)
        if all((codes[s : s + n - p] == codes[s + p : s + n]).all() for s, n, p in found.tolist()):
            return found
    raise RuntimeError("window hashes collide under every seed")


def _runs(codes: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    none = np.zeros((0, 3), np.int64)
    ok = inside(bounds, GRAM)
    if not ok.any():
        return none
    n = len(codes)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    # windows that would cross the end of a text are characters of their own
    chars = np.append(mix64(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40)), mix64(np.uint64(1 << 41) + np.arange(1, dtype=np.uint64)))
    grams = windows(mix64(codes.astype(np.uint64)), GRAM, seed)
    chars[: len(grams)] = np.where(ok, mix64(grams + mix64(doc[: len(grams)])), chars[: len(grams)])
    first, order, levels = suffix_classes(chars)
    same = levels[0][order[1:]] == levels[0][order[:-1]]
    lcp = np.zeros(n + 1, np.int64)  # of a suffix and the next one in order
    s = np.flatnonzero(same)
    if not len(s):
        return none
    lcp[s] = common_prefixes(order[s], order[s + 1], levels) + GRAM - 1
    del levels
    # the longest common prefix of a position with any other, and the distance to the nearest equal window
    longest = np.maximum(lcp, np.append(0, lcp[:-1]))
    gap = np.full(n + 1, n, np.int64)
    near = np.flatnonzero(chars[first[1:]] == chars[first[:-1]])
    step = first[near + 1] - first[near]
    gap[first[near]] = step
    gap[first[near + 1]] = np.minimum(gap[first[near + 1]], step)
    kept = np.flatnonzero((LEAST - 1) * gap[order] <= longest)
    if len(kept) < 2:
        return none
    between = np.minimum.reduceat(lcp, kept)[:-1]
    edges = np.flatnonzero(between)
    edges = edges[np.argsort(-between[edges], kind="stable")]
    found = _seeds(order[kept].tolist(), zip(between[edges].tolist(), edges.tolist()))
    out = np.array([(start, end - start, d) for (d, end), start in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The periodic runs of every whole text, and the text with each run cut to its first period.

    Returns doc_id (long), n_words, runs (start as word number, length, period; by start, then period) and collapsed (the
    kept words joined by one space), a row for each input row. A word goes if any run holds it after that
    run's first period. A null text has no words; repeated rows give equal rows; a null doc_id stays
    null. Other columns are not read. A document is one task's work: memory is its words times the logarithm of its longest repeat.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = split(column(part, "text"))
            found = runs_of(w.codes, w.bounds)
            edge = np.zeros(len(w.codes) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 0] + found[:, 1], -1)
            keep = np.cumsum(edge)[: len(w.codes)] == 0
            data, starts, ends = joined(w, keep)
            left = np.append(0, np.cumsum(keep))[w.bounds]
            # the space after a text's last word goes with the offsets of the next text
            begin = np.append(starts, len(data))[left]
            texts = [data[a : max(a, b - 1)].tobytes().decode() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            doc = np.searchsorted(w.bounds, found[:, 0], side="right") - 1
            flat = pa.StructArray.from_arrays([pa.array(found[:, 0] - w.bounds[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(item))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(np.diff(w.bounds)), lists, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """What ``collapse`` found, as one row of numbers and digests a document."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    placed = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.s"), F.col("b.length"), -F.col("b.p")
    milli = F.expr("(1000 * b.length) div (-b.p)")
    return placed.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_periodic_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where one document in ten, by the checksum of its id, ends in a repeated stretch of its own words.

    With h = crc32 of the decimal id, g = floor(h / 10) and n words, a document with h % 10 = 0 has each
    word i from a = g % n on replaced by word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)), joined by one space. A null id stays as it is.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    marked = rows.withColumn("w", words).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("w"))
    placed = marked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("w", (at(i) + 1).cast("int"))), " ")
    return placed.select("doc_id", F.when((h % 10 == 0) & (F.col("n") > 0), tail).otherwise(F.col("text")).alias("text"))
