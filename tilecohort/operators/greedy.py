"""Greedy spatial selection without a task that holds a group.

A greedy pass takes a row unless one taken before lies nearer than a distance. Its
result is the lexicographically first independent set, which rounds over blocks of
space find: a block goes through its open rows in order, with those of its
neighbours that lie within the distance. A row near a taken one is passed over; a
row near none, taken or open, is taken; a row near an open one that comes before it stays open if
that one's own fate hangs on rows the block doesn't see. The best open row of a group is always decided, and
blocks shift by half from round to round, so what a border kept open is inside a block next.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settled

#: Edge of a block in distances.
EDGE = 64
#: How a row stands; seen is an open row of another block.
_OPEN, _TAKEN, _PASSED, _SEEN = 0, 1, 2, 3


#: Cells are numbered _ROW * x + y; cells that share a number only cost a comparison.
_ROW, _FAR = 1 << 20, float(1 << 40)
_AROUND = [_ROW * i + j for i in (0, -1, 1) for j in (0, -1, 1)]


def _hit(points: dict[int, list[tuple[float, float]]], cell: int, x: float, y: float, r: float, square: bool) -> bool:
    """Whether a point lies nearer than r to (x, y)."""
    for d in _AROUND:
        for px, py in points.get(cell + d, ()):
            if (abs(px - x) < r and abs(py - y) < r) if square else (px - x) ** 2 + (py - y) ** 2 < r * r:
                return True
    return False


def _rounds(batches: Iterator[pa.RecordBatch], square: bool) -> Iterator[pa.RecordBatch]:
    """Decides the rows of blocks, each in order with its taken rows first; memory holds the taken and open rows of one block."""
    last, taken, waiting = None, {}, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        g, bx, by, x, y, r, s, own = (batch.column(batch.schema.get_field_index(n)) for n in ("_g", "_bx", "_by", "_x", "_y", "_r", "_s", "_own"))
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (g, bx, by)], axis=0)
        fresh[0] = last != (g[0].as_py(), bx[0].as_py(), by[0].as_py())
        last = (g[-1].as_py(), bx[-1].as_py(), by[-1].as_py())
        x, y, r = (c.to_numpy(zero_copy_only=False) for c in (x, y, r))
        with np.errstate(invalid="ignore"):
            column, line = (np.clip(np.nan_to_num(np.floor_divide(v, r)), -_FAR, _FAR).astype(np.int64) for v in (x, y))
        status = [_PASSED] * batch.num_rows
        for i, (new, cell, x, y, r, s) in enumerate(zip(fresh.tolist(), (column * _ROW + line).tolist(), x.tolist(), y.tolist(), r.tolist(), s.to_pylist())):
            if new:
                taken, waiting = {}, {}
            if s == _TAKEN:
                taken.setdefault(cell, []).append((x, y))
            elif taken and _hit(taken, cell, x, y, r, square):
                pass
            elif s == _SEEN or (waiting and _hit(waiting, cell, x, y, r, square)):
                status[i] = _OPEN
                waiting.setdefault(cell, []).append((x, y))
            else:
                status[i] = _TAKEN
                taken.setdefault(cell, []).append((x, y))
        at = batch.schema.get_field_index("_s")
        yield batch.set_column(at, batch.schema.field(at), pa.array(status, pa.int8())).filter(own)


def independent(rows: DataFrame, by: list[str], x: str, y: str, apart: Column | float, *order: Column, square: bool = False) -> DataFrame:
    """rows with ``taken``: whether a greedy pass over the group in ``order`` takes them.

    A row is passed over if a taken one before it lies nearer than ``apart`` (constant in a group; Euclidean, or the larger of both axes if ``square``).
    The order should be without ties; equal rows are taken one after another. Null keys are one group; no keys at all are one too. A row whose place is null or not a
    number is never taken; an ``apart`` that isn't positive takes every other row. The rows are written to the shared folder, once as a whole and then those still open.
    """
    radius = (F.lit(float(apart)) if isinstance(apart, (int, float)) else apart).cast("double")
    g = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)])) if by else F.lit("")
    placed = rows.withColumns({"_g": g, "_x": F.col(x).cast("double"), "_y": F.col(y).cast("double"), "_r": radius})
    real = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    free = (F.coalesce(F.col("_r"), F.lit(0.0)) <= 0) & real
    rest = placed.filter(~real | free).select(*rows.columns, (F.coalesce(free, F.lit(False))).alias("taken"))
    todo = placed.filter(real & ~free).withColumn("_s", F.lit(_OPEN).cast("tinyint"))
    found: list[DataFrame] = []
    names = [*rows.columns, "_g", "_x", "_y", "_r", "_s"]
    for turn in itertools.count():
        # places often begin at 0, so no border lies there
        edge, shift = F.col("_r") * EDGE, 0.25 + (turn % 2) / 2
        at = lambda v: F.floor(v / edge + shift).cast("long")  # noqa: B023, E731
        reach = lambda c: F.array_distinct(F.array(at(F.col(c) - F.col("_r")), at(F.col(c)), at(F.col(c) + F.col("_r"))))  # noqa: B023, E731
        shown = todo.withColumn("_bx", F.explode(reach("_x"))).withColumn("_by", F.explode(reach("_y")))
        own = (F.col("_bx") == at(F.col("_x"))) & (F.col("_by") == at(F.col("_y")))
        dealt = shown.withColumn("_own", own & (F.col("_s") == _OPEN)).withColumn("_s", F.when((F.col("_s") == _OPEN) & ~own, F.lit(_SEEN)).otherwise(F.col("_s")).cast("tinyint"))
        # the hash comes first, for numbers are sorted faster than keys
        sorted_ = dealt.repartition("_g", "_bx", "_by").sortWithinPartitions(F.xxhash64("_g"), "_g", "_bx", "_by", (F.col("_s") != _TAKEN), *order)
        decided = settled(sorted_.mapInArrow(lambda b: _rounds(b, square), sorted_.schema).select(*names), "greedy")
        found.append(decided.filter(F.col("_s") != _OPEN))
        open_ = decided.filter(F.col("_s") == _OPEN)
        if open_.isEmpty():
            break
        # a row that stayed open has met all taken rows but those of this round
        todo = open_.unionByName(decided.filter(F.col("_s") == _TAKEN))
    whole = rest
    for part in found:
        whole = whole.unionByName(part.select(*rows.columns, (F.col("_s") == _TAKEN).alias("taken")))
    return whole
