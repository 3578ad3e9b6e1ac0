"""Exact integer k-means with a vantage-point tree over the centroids.

Each round builds the tree anew on the driver (k points), broadcasts it, and lets
every vector search it best first: of its open nodes the one with the least lower
bound comes next, its vantage centroid is compared in integers, and its two halves are opened
with the bounds the triangle inequality gives. A node stays open as long as its
bound is not above the distance found so far; equal distances go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .words import column

#: More centroids than this are refused: a tree is broadcast, and its size is MOST_CENTROIDS times the vector's at most.
MOST_CENTROIDS = 4096
#: Components beyond this (either sign) are refused: squared distances of LARGEST_DIMS components stay below 2**62.
LARGEST, LARGEST_DIMS = 1 << 26, 256
#: Numbers of a block of vectors: its rows times nodes, or times components.
_BLOCK = 1 << 21


@dataclass
class Tree:
    """A node is a centroid and up to two halves of the rest, nearer and farther ones, each with the range of its distances to the centroid."""

    points: np.ndarray
    child: np.ndarray  # (nodes, 2), -1 for none
    low: np.ndarray  # (nodes, 2)
    high: np.ndarray

    @staticmethod
    def over(points: np.ndarray) -> Tree:
        """Node i holds centroid i."""
        k = len(points)
        tree = Tree(points, np.full((k, 2), -1), np.zeros((k, 2)), np.zeros((k, 2)))
        todo = [np.arange(k)] if k else []
        while todo:
            top, rest = (members := todo.pop())[0], members[1:]
            d = np.sqrt(((points[rest] - points[top]) ** 2).sum(1).astype(float))
            by = np.argsort(d, kind="stable")
            for side, half in enumerate(np.array_split(by, 2)):
                if len(half):
                    # the child's vantage centroid is the farthest of its half, which spreads distances most
                    own = rest[half[::-1]]
                    tree.child[top, side], tree.low[top, side], tree.high[top, side] = own[0], d[half].min(), d[half].max()
                    todo.append(own)
        return tree

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of x; ties to the smaller number."""
        n, k = len(x), len(self.points)
        number, best, radius = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, np.inf)
        bound = np.full((n, k), np.inf)
        bound[:, :1] = 0
        live = np.arange(n)
        while True:
            node = bound[live].argmin(1)
            least = bound[live, node]
            go = np.isfinite(least) & (least <= radius[live])
            live, node = live[go], node[go]
            if not len(live):
                return number, best
            parent = least[go]
            bound[live, node] = np.inf
            apart = x[live] - self.points[node]
            square = np.einsum("ij,ij->i", apart, apart)
            better = (square < best[live]) | ((square == best[live]) & (node < number[live]))
            at = live[better]
            number[at], best[at] = node[better], square[better]
            d = np.sqrt(square.astype(float))
            radius[at] = d[better]
            for side in (0, 1):
                child = self.child[node, side]
                has = child >= 0
                lo, hi, mine = self.low[node[has], side], self.high[node[has], side], d[has]
                # distances are rounded roots of integers: bounds give way by more than that rounding
                gap = np.maximum(mine - hi, lo - mine) - 1e-12 * (mine + hi)
                bound[live[has], child[has]] = np.maximum(gap, parent[has])


def vectors_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The column ``x`` (lists of dims integers, none null) as a matrix."""
    x = column(batch, "x")
    out = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if out.size and (out.max() >= LARGEST or out.min() <= -LARGEST):
        raise ValueError(f"components must lie within {LARGEST} of zero")
    return out


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    rows = max(1, _BLOCK // max(dims, len(tree.points)))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            x = vectors_of(part, dims)
            yield part, x, *tree.nearest(x)


def integers(rows: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors with exactly dims components, none null or non-finite."""
    v = F.transform(vector, lambda c: c.cast("double"))
    good = (F.size("v") == dims) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(vec_id).alias("id"), v.alias("v")).filter(good).select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _sums(rows: DataFrame, shared: Broadcast, dims: int) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """(vectors, component sums, sum of distances) of each cluster; a task sends a row a cluster, and k times dims numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        k = len(tree.points)
        count, total, far = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, object)
        for _, x, number, square in _assigned(batches, tree, dims):
            by = np.argsort(number, kind="stable")
            own, first = np.unique(number[by], return_index=True)
            count[own] += np.diff(np.append(first, len(by)))
            total[own] += np.add.reduceat(x[by], first, axis=0)
            # halves of the distances are summed apart, so no sum leaves 64 bits
            high, low = np.add.reduceat(square[by] >> 32, first), np.add.reduceat(square[by] & 0xFFFFFFFF, first)
            far[own] += (high.astype(object) << 32) + low
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array([int(f) for f in far[own]], pa.decimal128(38, 0)), pa.array(list(total[own]), pa.list_(pa.int64()))], names=["c", "n", "far", "total"])

    parts = rows.mapInArrow(run, "c int, n long, far decimal(38,0), total array<long>").select("c", "n", "far", F.posexplode("total").alias("place", "part"))
    k = len(shared.value.points)
    count, total, far = np.zeros(k, object), [[0] * dims for _ in range(k)], [0] * k
    for r in parts.groupBy("c", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n"), F.sum("far").alias("far")).collect():
        count[r.c], total[r.c][r.place], far[r.c] = r.n, int(r.part), int(r.far)
    return count, total, far


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, salt: int = 3) -> DataFrame:
    """Clusters integer vectors around k centroids: ``rounds`` rounds of assignment and componentwise floor of the mean, then one more assignment.

    Returns vec_id (its own type), cluster (int), distance (long, squared), cluster_inertia and inertia (long) and
    centroid_sha256, a row for each vector kept. Vectors that are null, of other length, or hold a null or non-finite component fall out.
    Centroids begin as the k vectors with least sha256 of "<salt>:<vec_id>" (a null id counts as empty; rows of one id go by their
    components), or all if there are fewer; repeated rows count each time. An empty centroid stays where it is. An empty table gives no row.
    Other columns aren't read. The integers are written to the shared folder once, for the rounds read them again.
    """
    if not 0 < k <= MOST_CENTROIDS or dims > LARGEST_DIMS:
        raise ValueError(f"k must lie in 1..{MOST_CENTROIDS}, dims be {LARGEST_DIMS} at most")
    spark = rows.sparkSession
    kept = written(integers(rows, vec_id, vector, dims, scale), "vectors")
    kind = kept.schema["id"].dataType.simpleString()
    fields = f"`{vec_id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.orderBy(order, "x").limit(k).collect()
    if not first:
        discard(kept)
        return spark.createDataFrame([], fields)
    points = np.array([r.x for r in first], np.int64).reshape(-1, dims)
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Tree.over(points))
        count, total, far = _sums(kept, shared, dims)
        if turn < rounds:
            shared.unpersist()
            points = np.array([[t // int(n) for t in own] if n else old.tolist() for own, n, old in zip(total, count, points)], np.int64)
    whole = sum(far)
    named = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, square in _assigned(batches, shared.value, dims):
            own = pa.array(far, pa.int64()).take(pa.array(number))
            cols = [column(part, "id"), pa.array(number, pa.int32()), pa.array(square), own, pa.array([whole] * part.num_rows, pa.int64()), pa.array(named, pa.string()).take(pa.array(number))]
            yield pa.RecordBatch.from_arrays(cols, names=[vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(run, fields)
