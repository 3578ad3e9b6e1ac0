"""Bootstrap bands of ROC and precision-recall curves and of the area under the former.

A row's multiplicity in a resample is a Poisson draw from a hash of its key and the
resample's number, so resamples are columns of a matrix that each task makes for its
own rows: rows are dealt out by ranges of group and score once, and not once a resample. A
range sums up its resamples; sums over the ranges before it come from a window over
ranges, a row a range and resample. Knowing them, a range finds the grid places that its part
of each resampled curve crosses. What leaves it are those values, samples times places in all, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import PART, ranged
from .scratch import settled

# The distribution function of a Poisson variable with mean 1.
POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759]
# The increment and multipliers of a published 32-bit finaliser.
STEP, FIRST, SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
_CUTS = [np.uint32(int(np.ceil(p * 2**32))) for p in POISSON]
#: Rows whose draws are held at once.
_ROWS = 512


def draws(x: np.ndarray, samples: int) -> np.ndarray:
    """Multiplicities (rows, samples) of rows with 32-bit hashes x; resamples are numbered from 1."""
    h = x.astype(np.uint32)[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * STEP).astype(np.uint32)[None, :]
    h ^= h >> np.uint32(16)
    h *= np.uint32(FIRST)
    h ^= h >> np.uint32(13)
    h *= np.uint32(SECOND)
    h ^= h >> np.uint32(16)
    return sum((h >= c).astype(np.uint8) for c in _CUTS)


def key_hash(key: str, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _steps(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[tuple]:
    """Goes through rows sorted by (range, group, header first, score downwards): ("header", key, vectors), or ("steps", key, p, n), the
    resampled positives and negatives (distinct scores, samples) of some successive scores of one range and group; no score is cut."""
    key = score = p = n = None
    for batch in batches:
        keys = list(zip(_column(batch, PART).to_pylist(), _column(batch, "_g").to_pylist()))
        head = _column(batch, "_head").to_pylist()
        scores, truth, x = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("_score", "_truth", "_x"))
        new = np.array([i == 0 or keys[i] != keys[i - 1] or head[i] is not None or head[i - 1] is not None for i in range(len(keys))])
        for a, b in zip(np.flatnonzero(new).tolist(), np.append(np.flatnonzero(new)[1:], len(keys)).tolist()):
            if keys[a] != key or head[a] is not None:
                if p is not None:
                    yield "steps", key, p, n
                key, p, n = keys[a], None, None
            if head[a] is not None:
                yield "header", key, head[a]
                continue
            for i in range(a, b, _ROWS):
                j = min(i + _ROWS, b)
                m = draws(x[i:j], samples)
                own = scores[i:j]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                yes = truth[i:j, None].astype(np.uint8)
                dp, dn = (np.add.reduceat(part, at, axis=0, dtype=np.int64) for part in (m * yes, m * (1 - yes)))
                if p is not None and own[0] == score:
                    dp[0] += p[-1]
                    dn[0] += n[-1]
                    p, n = p[:-1], n[:-1]
                if p is not None and len(p):
                    yield "steps", key, p, n
                # the last score may go on
                if len(at) > 1:
                    yield "steps", key, dp[:-1], dn[:-1]
                p, n, score = dp[-1:], dn[-1:], own[-1]
    if p is not None:
        yield "steps", key, p, n


def _sums(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Of each range and group: positives, negatives, and pairs won within it, by resample."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), *[pa.array([v], pa.list_(pa.float64())) for v in (tp, fp, won)]], names=[PART, "_g", "p", "n", "won"])

    key = None
    for _, at, p, n in _steps(batches, samples):
        if at != key:
            if key is not None:
                yield row()
            key, tp, fp, won = at, np.zeros(samples), np.zeros(samples), np.zeros(samples)
        above = tp + np.cumsum(p, axis=0) - p
        won = won + (n * (above + p / 2)).sum(0)
        tp, fp = tp + p.sum(0), fp + n.sum(0)
    if key is not None:
        yield row()


def _crossed(x0: np.ndarray, x1: np.ndarray, all_: np.ndarray, y0: np.ndarray, y1: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the grid places from x0 up to, not at, x1 (counts of all_), linear between y0 and y1; matrices of (scores, samples)."""
    full = np.maximum(all_, 1)[None, :]
    low = -(-x0 * (steps - 1) // full)
    many = np.where(all_[None, :] > 0, -(-x1 * (steps - 1) // full) - low, 0)
    k, s = np.nonzero(many)
    times = many[k, s]
    k, s = np.repeat(k, times), np.repeat(s, times)
    place = low[k, s] + np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
    part = (place * all_[s] / (steps - 1) - x0[k, s]) / (x1 - x0)[k, s]
    return place, y0[k, s] + (y1 - y0)[k, s] * part


def _places(batches: Iterator[pa.RecordBatch], samples: int, steps: int) -> Iterator[pa.RecordBatch]:
    """(group, curve, place, values) of what the resampled curves cross in each range; curve 0 is ROC, 1 precision and recall."""
    key = None
    for kind, at, *what in _steps(batches, samples):
        if kind == "header":
            key, (tp, fp, all_p, all_n) = at, (np.array(v, np.int64) for v in what[0])
            live = (all_p > 0) & (all_n > 0)
            continue
        if at != key:
            raise RuntimeError("a range without its header")
        p, n = what
        t1, f1 = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
        t0, f0 = t1 - p, f1 - n
        precision = lambda t, f: np.where(t + f > 0, t / np.maximum(t + f, 1), 1.0)
        sides = ((f0, f1, np.where(live, all_n, 0), t0 / np.maximum(all_p, 1), t1 / np.maximum(all_p, 1)), (t0, t1, np.where(live, all_p, 0), precision(t0, f0), precision(t1, f1)))
        for curve, side in enumerate(sides):
            place, value = _crossed(*side, steps)
            if len(place):
                by = np.argsort(place, kind="stable")
                own, first = np.unique(place[by], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(by)), pa.int32()), pa.array(value[by]))
                yield pa.RecordBatch.from_arrays([pa.array([at[1]] * len(own), pa.string()), pa.array([curve] * len(own), pa.int32()), pa.array(own, pa.int32()), lists], names=["_g", "curve", "step", "values"])
        tp, fp = t1[-1], f1[-1]


class Resampled:
    """Resamples of rows (truth 0 or 1, a score, a key that tells rows apart) of each group; null keys are one group, rows without truth or score are left out."""

    def __init__(self, rows: DataFrame, by: list[str], key: str, truth: str = "truth", score: str = "score", samples: int = 1000, seed: int = 0):
        self.by, self.samples = by, samples
        g = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)])) if by else F.lit("")
        real = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
        slim = real.select(*by, g.alias("_g"), F.col(score).cast("double").alias("_score"), F.col(truth).cast("int").alias("_truth"), key_hash(key, seed).alias("_x"))
        self.groups = slim.select("_g", *by).distinct()
        self.dealt = ranged(slim.drop(*by), ["_g"], F.desc("_score"))
        self.none = F.lit(None).cast("array<array<double>>")
        blocks = self._sorted(self.dealt.withColumn("_head", self.none)).mapInArrow(lambda b: _sums(b, samples), f"{PART} int, _g string, p array<double>, n array<double>, won array<double>")
        each = settled(blocks, "resamples").select(PART, "_g", F.posexplode(F.arrays_zip("p", "n", "won")).alias("s", "v")).select(PART, "_g", "s", "v.*")
        w = Window.partitionBy("_g", "s")
        before = lambda c: F.coalesce(F.sum(c).over(w.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        self.upto = each.select(PART, "_g", "s", "p", "n", "won", before("p").alias("bp"), before("n").alias("bn"), F.sum("p").over(w).alias("ap"), F.sum("n").over(w).alias("an"))

    def _sorted(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(PART).sortWithinPartitions(PART, "_g", F.col("_head").isNull(), F.desc("_score"))

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.groups, "_g").select(*self.by, *[c for c in rows.columns if c != "_g"])

    def areas(self) -> DataFrame:
        """(by, s, a): the area under the ROC curve of each resample that has both classes."""
        won = self.upto.groupBy("_g", "s").agg(F.sum(F.col("won") + F.col("n") * F.col("bp")).alias("w"), F.max("ap").alias("ap"), F.max("an").alias("an"))
        return self._named(won.select("_g", "s", F.try_divide(F.col("w"), F.col("ap") * F.col("an")).alias("a")).filter("a IS NOT NULL"))

    def bands(self, steps: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
        """(by, curve, step, low, high): what the resampled curves lie between at ``steps`` equal distances from 0 to 1.

        ``curve`` is roc (true-positive rate over false-positive rate) or pr (precision over recall; 1 before the first row). A curve is linear between
        its points; of several at one place the last one counts. Resamples with one class are left out.
        """
        vectors = F.array_sort(F.collect_list(F.struct("s", "bp", "bn", "ap", "an")))
        heads = self.upto.groupBy(PART, "_g").agg(vectors.alias("v")).select(PART, "_g", F.array(*[F.transform("v", lambda r: r[c]) for c in ("bp", "bn", "ap", "an")]).alias("_head"))  # noqa: B023
        rows = self.dealt.withColumn("_head", self.none).unionByName(heads, allowMissingColumns=True)
        samples = self.samples
        found = self._sorted(rows).mapInArrow(lambda b: _places(b, samples, steps), "_g string, curve int, step int, values array<double>")
        both = self.upto.filter("ap > 0 AND an > 0").select("_g", "s", "ap", "an").distinct()
        end = both.groupBy("_g").agg(F.collect_list(F.lit(1.0)).alias("roc"), F.collect_list(F.col("ap") / (F.col("ap") + F.col("an"))).alias("pr"))
        last = end.select("_g", F.posexplode(F.array("roc", "pr")).alias("curve", "values")).select("_g", "curve", F.lit(steps - 1).alias("step"), "values")
        whole = found.unionByName(last).groupBy("_g", "curve", "step").agg(F.array_sort(F.flatten(F.collect_list("values"))).alias("v"))

        def quantile(q: float) -> Column:
            at = F.lit(q) * (F.size("v") - 1)
            a, b = F.element_at("v", (F.floor(at) + 1).cast("int")), F.element_at("v", (F.ceil(at) + 1).cast("int"))
            return a + (b - a) * (at - F.floor(at))

        return self._named(whole.select("_g", F.when(F.col("curve") == 0, "roc").otherwise("pr").alias("curve"), "step", quantile(low).alias("low"), quantile(high).alias("high")))
