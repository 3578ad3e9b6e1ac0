"""SimHash near-duplicates: fingerprints, deletion-variant signatures, components.

Fingerprints are cut into three segments. Of two that differ in at most BITS bits, the last segments are equal, or else
three bits at most are left to the others, so one of these differs in at most one bit. So the first two
are indexed once for each of their bits with that bit as a wildcard, and the last one as it is: 43 keys a fingerprint, and
equal keys are joined and verified.

Equal fingerprints are one node. A group of near copies shares most keys, so pairs aren't
formed within a bucket: each fingerprint is first verified against a few with an equal
segment, drawn by hash, and components are found; then only fingerprints of different components
of a bucket are compared, those of its largest component with the others but not with each other.
A bucket of two needs no join: both are in its aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_joined, one_text_each, written
from .components import connected
from .words import column, joined, slices, split

SHINGLE = 4
BITS = 4
#: (first bit, bits) of the segments; (BITS - 1) // 2 = 1, so the last one needs no wildcards.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a bucket of equal segments that its members are compared with first.
HUBS = 16
#: A bucket with a SHARE-th of all fingerprints or more is dealt out to PIECES tasks.
SHARE, PIECES = 100, 64
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprints_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, fingerprint) of each text: repeated shingles count each time; fewer than SHINGLE words are one shingle, no word gives zero."""
    w = split(texts, lower=True)
    data, starts, ends = joined(w)
    data, n = data.tobytes(), np.diff(w.bounds)
    shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), shingles)
    before = np.cumsum(shingles) - shingles
    first = np.arange(len(doc)) - before[doc] + w.bounds[doc]
    last = first + np.minimum(n[doc], SHINGLE) - 1
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(data[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(doc))
    ones = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(h), _BLOCK):
        bits = np.unpackbits(h[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, at = np.unique(doc[i : i + _BLOCK], return_index=True)
        ones[own] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    set_ = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
    return shingles, np.ascontiguousarray(set_).view("<u8").ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (long), n_shingles and fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, fp = fingerprints_of(column(part, "text"))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(n), pa.array(fp.view(np.int64))], names=["doc_id", "n_shingles", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, fp long")


def variants(fp: Column) -> Column:
    """The 43 keys of a fingerprint, each in one long: (number of the wildcard bit, its segment with that bit cleared), and the last segment."""
    keys = [F.element_at(plain(fp), -1)]
    for start, width in SEGMENTS[:-1]:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        keys += [segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << j))) + F.lit((start + j) << 22) for j in range(width)]
    return F.array(*keys)


def plain(fp: Column) -> Column:
    """The three segments of a fingerprint as they are, each as (number, bits) in one long."""
    return F.array(*[F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(start << 22) for start, width in SEGMENTS])


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def _stars(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of each node with the first near one of HUBS fingerprints, drawn by hash, of each bucket of equal segments, and of these with each other."""
    keys = nodes.select("doc", "fp", F.explode(plain(F.col("fp"))).alias("key"))
    drawn = keys.groupBy("key", F.pmod(F.xxhash64("key", "doc"), F.lit(HUBS)).alias("slot")).agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc", "key").alias("h"), "doc", "fp")).alias("m"))
    buckets = written(drawn.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("m")).alias("hubs")), "buckets")
    near = F.filter("hubs", lambda m: (m["doc"] != F.col("doc")) & _near(m["fp"], F.col("fp")))
    first = hot_joined(keys, buckets, ["key"], "n", "inner", merged=True).select(F.col("doc").alias("u"), F.get(near, 0)["doc"].alias("v")).filter("v IS NOT NULL")
    links = written(first.distinct(), "links")
    discard(buckets)
    return links


def linked(nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes (doc: long, fp; a row a fingerprint) that link with any other."""
    links = _stars(nodes)
    same = written(connected(links), "components")
    sizes = same.groupBy("component").agg(F.count("*").alias("size"))
    named = hot_joined(same, written(sizes, "sizes"), ["component"], "size", "inner", merged=True).select(F.col("node").alias("doc"), F.col("component").alias("c"), "size")
    labelled = written(nodes.join(named.hint("merge"), "doc", "left").select("fp", F.coalesce("c", "doc").alias("c"), F.coalesce("size", F.lit(1).cast("long")).alias("size")), "labelled")

    # buckets of several components; the one with most members anywhere isn't compared with itself
    keys = labelled.select("fp", "c", "size", F.explode(variants(F.col("fp"))).alias("key"))
    member = F.struct("size", "c", "fp")
    mixed = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min(member).alias("lo"), F.max(member).alias("hi")).filter("lo.c <> hi.c").select("key", "n", "lo", "hi"), "mixed")
    pairs = mixed.filter((F.col("n") == 2) & _near(F.col("lo.fp"), F.col("hi.fp"))).select(F.col("lo.c").alias("u"), F.col("hi.c").alias("v"))
    many = mixed.filter("n > 2").select(F.col("key").alias("k"), "n", F.col("hi.c").alias("most"))
    # a fingerprint is in 43 buckets, so 43 * SHARE buckets at most hold a SHARE-th of all fingerprints each
    hot = [r.k for r in many.filter(F.col("n") * SHARE > labelled.count()).select("k").collect()]
    is_hot = lambda k: k.isin(hot) if hot else F.lit(False)
    of = (F.col("key") == F.col("k")) & (F.col("c") != F.col("most"))
    # merged: Spark takes an exploded table for as small as what it comes from and would broadcast the keys
    rare = keys.filter(~is_hot(F.col("key"))).join(many.filter(~is_hot(F.col("k"))).hint("merge"), of)
    minor = written(keys.filter(is_hot(F.col("key"))).join(F.broadcast(many.filter(is_hot(F.col("k")))), of).unionByName(rare).select("key", F.col("fp").alias("fp2"), F.col("c").alias("c2")), "minor")
    # the rows of a hot bucket are dealt out to PIECES tasks, each with all its smaller components
    left = keys.select("key", "fp", "c", F.when(is_hot(F.col("key")), F.pmod(F.xxhash64("fp"), F.lit(PIECES))).otherwise(0).cast("int").alias("piece"))
    right = minor.select(F.col("key").alias("k"), "fp2", "c2", F.explode(F.when(is_hot(F.col("key")), F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))).alias("p"))
    across = left.join(right.hint("merge"), (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p")) & (F.col("c") != F.col("c2")) & _near(F.col("fp"), F.col("fp2")))
    more = pairs.unionByName(across.select(F.col("c").alias("u"), F.col("c2").alias("v"))).distinct()
    result = written(connected(same.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")
    for table in (links, same, labelled, mixed, minor):
        discard(table)
    return result


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose fingerprints differ in at most BITS bits.

    Returns doc_id (long), n_shingles, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable, itself
    included), a row for each input row. Texts that are null or without a word have fingerprint zero and are linked like
    any other. Rows that repeat a doc_id and its text are one document, and with different shingles or fingerprints raise; a null doc_id
    is linked with nothing and has a null component. Other columns are not read.
    """
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    one_text_each(rows, "doc_id", "n_shingles", "fp")
    nodes = written(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "nodes")
    same = linked(nodes.select("doc", "fp"))
    classes = written(nodes.join(same.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").select("fp", "n", F.coalesce("component", "doc").alias("component")), "classes")
    found = hot_joined(rows, classes, ["fp"], "n", "left")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    discard(nodes)
    return found.select("doc_id", "n_shingles", digits.alias("fingerprint"), component.alias("component_id"))
