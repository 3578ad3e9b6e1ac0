"""Vector operators: normalisation, exact nearest references, novelty, centroid distance.

Vectors are ``array<float>`` columns and arithmetic is in double. The nearest-reference
search multiplies Arrow batches by blocks of about BLOCK reference vectors: broadcast
if there is one, else dealt out in the cluster; partial results merge by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a block; so many references are broadcast at most.
BLOCK = 4096
#: Similarities that a task holds at once.
SLICE = 1 << 21
LEAST_NORM = 1e-12
TOP_K, LOGIT_SCALE, NOVELTY_K = 7, 3.0, 20
W_NOVELTY, W_CENTROID = 0.55, 0.40


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector over its length, which counts as 1e-12 at least."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(LEAST_NORM)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def _matrix(values: pa.Array) -> np.ndarray:
    n = len(values)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(n, -1) if n else flat.reshape(0, 0)
    return m / np.maximum(np.sqrt((m * m).sum(1)), LEAST_NORM)[:, None] if n else m


def _best(q: np.ndarray, ids: np.ndarray, refs: np.ndarray, vectors: pa.Array, k: int, skip_self: bool, lists: np.ndarray | None = None, wanted: np.ndarray | None = None) -> pa.Table:
    """(id, ref, sim) of the k references of a block that are most like each query; SLICE similarities are in memory at once.

    With ``lists``, the list of each reference, a query meets the references of the lists that its row of ``wanted`` has.
    """
    order = np.argsort(ids, kind="stable") if lists is None else np.lexsort((ids, lists))
    ids, r, x, m = ids[order], refs[order], _matrix(vectors), len(ids)
    edges = np.unique(lists[order], return_index=True) if lists is not None else ((), ())
    spans = list(zip(edges[0], edges[1], [*edges[1][1:], m]))
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, SLICE // max(m, 1))
    for at in range(0, len(q) if m else 0, step):
        own, part = q[at : at + step], x[at : at + step]
        if lists is None:
            sim = part @ r.T
        else:
            sim = np.full((len(own), m), -np.inf)
            for name, a, b in spans:
                asks = np.flatnonzero(wanted[at : at + step, name])
                sim[asks, a:b] = part[asks] @ r[a:b].T
        if skip_self:
            sim[own[:, None] == ids[None, :]] = -np.inf
        sim[np.isnan(sim)] = -np.inf
        near = sim > -np.inf
        if m > k:
            # what rounds to the k-th best or more
            near &= sim >= np.partition(sim, m - k, axis=1)[:, m - k, None] - 2e-12
        row, col = np.nonzero(near)
        score = np.round(sim[row, col], 12)
        best = np.lexsort((ids[col], -score, row))
        row, col, score = row[best], col[best], score[best]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((own[row[keep]], ids[col[keep]], score[keep]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.array([], t) for t in (np.int64, np.int64, float)]
    return pa.table(dict(zip(("id", "ref", "sim"), map(pa.array, columns))))


def nearest(queries: DataFrame, references: DataFrame, k: int, id_: str = "id", vector: str = "vector", *, by: list[str] | None = None, skip_self: bool = False) -> DataFrame:
    """The k references most alike by cosine: (by, id, ref, sim, rank), ties to the smaller reference.

    With ``by``, references of the same group (a slide) count. Rows with a null vector are left out on both sides.
    Up to BLOCK references without groups are broadcast. Beyond that both sides are dealt into blocks of about
    BLOCK rows, every pair of a query and a reference block of a group is one task's product, and the best of the
    blocks are merged; the work is the product's own, and no block passes through the driver.
    """
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    fresh = [F.col(c).alias(c) for c in by]  # the two sides may be one table
    queries = queries.filter(F.col(vector).isNotNull()).select(*fresh, F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    references = references.filter(F.col(vector).isNotNull()).select(*fresh, F.col(id_).cast("long").alias("ref"), F.col(vector).alias("v"))
    rows = references.limit(BLOCK + 1).collect() if not by else []
    if not by and len(rows) <= BLOCK:
        held = queries.sparkSession.sparkContext.broadcast((np.array([r.ref for r in rows], np.int64), _matrix(pa.array([list(r.v) for r in rows]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, refs = held.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from _best(batch.column(0).to_numpy(zero_copy_only=False), ids, refs, batch.column(1), k, skip_self).to_batches()

        found = queries.mapInArrow(run, "id long, ref long, sim double")
    else:
        found = _in_blocks(queries, references, k, by, skip_self, kinds)
    rank = F.row_number().over(Window.partitionBy(*by, "id").orderBy(F.desc("sim"), "ref"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _in_blocks(queries: DataFrame, references: DataFrame, k: int, by: list[str], skip_self: bool, kinds: dict[str, str]) -> DataFrame:
    """Each query's k best of each reference block of its group."""
    blocks = lambda rows, to: rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(to))
    sizes = blocks(queries, "_c")
    sizes = sizes.join(blocks(references, "_b"), by) if by else sizes.crossJoin(blocks(references, "_b"))  # without groups one row each
    place = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda rows: rows.join(sizes, by) if by else rows.crossJoin(F.broadcast(sizes))
    keys = [*by, "c", "b"]
    own = [F.col(c).alias(c) for c in by]
    q = sized(queries).select(*own, place("id", "_c").alias("c"), every("_b").alias("b"), "id", "v")
    r = sized(references).select(*own, every("_c").alias("c"), place("ref", "_b").alias("b"), "ref", "v")

    def product(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in types})
        got = _best(left["id"].to_numpy(), right["ref"].to_numpy(), _matrix(right["v"].combine_chunks()), left["v"].combine_chunks(), k, skip_self)
        for i, c in enumerate(by):
            got = got.add_column(i, c, pa.array([key[i].as_py()] * got.num_rows, dict(types)[c]))
        return got

    types = [*((c, to_arrow_type(queries.schema[c].dataType)) for c in by), ("id", pa.int64()), ("ref", pa.int64()), ("sim", pa.float64())]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(product, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "id long", "ref long", "sim double"]))


def reference_scores(tiles: DataFrame, references: DataFrame, k: int = TOP_K, id_: str = "id", vector: str = "vector", good: str = "good", aggregation: str = "mean") -> DataFrame:
    """Margin and bad likelihood of each tile from its k nearest good and bad references.

    With one class of references the margin is that class's similarity (negated for bad ones).
    ``aggregation`` is mean, max or weighted (exp(-i / 3), normalised).
    """
    weight = F.exp(-(F.col("rank") - 1) / 3.0)
    how = {"mean": F.avg("sim"), "max": F.max("sim"), "weighted": F.sum(F.col("sim") * weight) / F.sum(weight)}[aggregation]
    per = []
    for name, wanted in (("good", True), ("bad", False)):
        n = nearest(tiles, references.filter(F.col(good) == wanted), k, id_, vector)
        per.append(n.groupBy("id").agg(F.round(how, 6).alias(f"{name}_score"), F.round(F.max("sim"), 6).alias(f"{name}_top1")))
    both = tiles.select(F.col(id_).alias("id")).join(per[0], "id", "left").join(per[1], "id", "left")
    margin = F.coalesce(F.col("good_score") - F.col("bad_score"), F.col("good_score"), -F.col("bad_score"))
    return both.withColumn("margin", F.round(margin, 6)).withColumn("bad_likelihood", F.round(sigmoid(-LOGIT_SCALE * F.col("margin")), 6))


def novelty(tiles: DataFrame, k: int = NOVELTY_K, id_: str = "id", vector: str = "vector", *, slide: str) -> DataFrame:
    """Mean cosine distance of each tile to the k nearest other tiles of its slide."""
    return nearest(tiles, tiles, k, id_, vector, by=[slide], skip_self=True).groupBy(slide, "id").agg(F.round(F.avg(1 - F.col("sim")), 6).alias("novelty"))


def centroid_distance(tiles: DataFrame, id_: str = "id", vector: str = "vector", *, slide: str) -> DataFrame:
    """Cosine distance of each tile to the renormalised mean of all normalised tiles of its slide."""
    unit = tiles.select(slide, F.col(id_).alias("id"), normalized(F.col(vector)).alias("u"))
    mean = unit.select(slide, F.posexplode("u").alias("p", "x")).groupBy(slide, "p").agg(F.avg("x").alias("x"))
    # a vector's length rows for each slide
    center = mean.groupBy(slide).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("c")).select(slide, normalized(F.col("c")).alias("c"))
    return unit.join(center, slide).select(slide, "id", F.round(1 - dot(F.col("u"), F.col("c")), 6).alias("centroid_distance"))


def reduced_precision(least_bits: int, seed: int = 0):
    """A function of (key, vector) that clears a random number of each value's low fraction bits and keeps ``least_bits`` at least.

    How many is drawn from the row's key, so a repeated task draws the same.
    """
    if least_bits < 1:
        raise ValueError("a fraction keeps a bit at least")

    @F.pandas_udf("array<float>")
    def run(key: pd.Series, vector: pd.Series) -> pd.Series:
        out = []
        for k, v in zip(key, vector):
            bits = np.asarray(v, np.float32).view(np.uint32)
            drop = np.random.default_rng([seed, int(k)]).integers(0, 23 - least_bits, len(bits)).astype(np.uint32)
            out.append((bits & (np.uint32(0xFFFFFFFF) << drop)).view(np.float32))
        return pd.Series(out)

    return run
