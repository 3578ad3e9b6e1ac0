"""Connected parts of masks that are stored tile by tile, and boxes made one, over whole slides.

A task labels the parts of its own tiles. Parts of neighbouring tiles that touch along
the border are united by large-star and small-star steps on the few labels that reach a border. Boxes
near each other meet in grid cells. No task holds a slide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.image import labelled
from .scratch import discard, settled


def united(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v: long) reaches.

    Large-star ties a node's larger neighbours to its least one, small-star the node itself and its smaller ones; they alternate until a pair of steps changes nothing.
    """
    edges = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    for _ in range(limit):
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = settled(around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = settled(large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u > v").distinct(), "edges")
        done = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        discard(large)
        discard(edges)
        edges = small
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("parts didn't settle")


def mask_parts(tiles: DataFrame, by: list[str], mask: str = "mask", height: int = 8, width: int = 8, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """(by, x, y, w, h, area) of the 4-connected parts of each slide's mask, which tiles (ty, tx) of height by width pixels make up.

    A tile that lacks counts as empty, as does a null mask; a null key is a slide of its own. Of a repeated tile any pixel set in one is set.
    """
    keys = tiles.select(*by, F.col(ty).cast("long").alias("ty"), F.col(tx).cast("long").alias("tx"), F.col(mask).alias("mask")).filter("mask IS NOT NULL AND ty IS NOT NULL AND tx IS NOT NULL")
    merged = keys.groupBy(*by, "ty", "tx").agg(F.collect_list("mask").alias("m")).withColumn("i", F.monotonically_increasing_id())
    rows = settled(merged, "tiles")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, ty_, tx_, masks in zip(*(batch.column(k).to_pylist() for k in range(4))):
                on = np.any([np.array(m, bool).reshape(height, width) for m in masks], axis=0)
                label = labelled(on)
                y, x = np.nonzero(on)
                part = label[y, x].astype(np.int64) - 1
                for p in np.unique(part).tolist():
                    py, px = y[part == p], x[part == p]
                    # where the part reaches a border: pixels as y * width + x
                    rim = (py % max(height - 1, 1) == 0) | (px % max(width - 1, 1) == 0)
                    out.append((tx_ * width + int(px.min()), ty_ * height + int(py.min()), tx_ * width + int(px.max()) + 1, ty_ * height + int(py.max()) + 1, len(py), (py[rim] * width + px[rim]).tolist(), i))
            names = ["x0", "y0", "x1", "y1", "area", "rim", "i"]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    parts = rows.select("i", "ty", "tx", "m").mapInArrow(label, "x0 long, y0 long, x1 long, y1 long, area long, rim array<long>, i long")
    found = settled(parts.join(rows.drop("m"), "i").withColumn("node", F.monotonically_increasing_id()), "parts")
    pixels = found.select(*by, "node", F.col("ty"), F.col("tx"), F.explode("rim").alias("p"))
    at = pixels.select(*by, "node", (F.col("ty") * height + F.floor(F.col("p") / width)).alias("py"), (F.col("tx") * width + F.col("p") % width).alias("px"), "ty", "tx")
    right, below = at.filter((F.col("px") + 1) % width == 0).withColumn("px", F.col("px") + 1), at.filter((F.col("py") + 1) % height == 0).withColumn("py", F.col("py") + 1)
    links = None
    for moved, first in ((right, at.filter(F.col("px") % width == 0)), (below, at.filter(F.col("py") % height == 0))):
        near = moved.withColumnRenamed("node", "v").alias("a").join(first.withColumnRenamed("node", "u").alias("b"), reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "py", "px"]])).select("u", "v").distinct()
        links = near if links is None else links.unionByName(near)
    roots = united(links)
    named = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = named.groupBy(*by, "root").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"), F.sum("area").alias("area"))
    return whole.drop("root")


def boxes_joined(boxes: DataFrame, by: list[str], gap: int, cell: int, limit: int = 30) -> DataFrame:
    """Boxes (by, x, y, w, h, area) within ``gap`` of each other in both axes made one, areas summed, until none are; null keys are one group.

    Boxes meet in grid cells of side ``cell``; each round unites all chains of near boxes, and a box that has grown may be near another one then.
    """
    now = settled(boxes.select(*by, "x", "y", "w", "h", "area").withColumn("i", F.monotonically_increasing_id()), "boxes")
    for _ in range(limit):
        over = lambda a, s: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(s) + gap) / cell)))
        dealt = now.withColumn("cx", over("x", "w")).withColumn("cy", over("y", "h"))
        a, b = dealt.alias("a"), dealt.alias("b")
        same = reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "cx", "cy"]])
        apart = lambda c, s: (F.col(f"a.{c}") + F.col(f"a.{s}") + gap < F.col(f"b.{c}")) | (F.col(f"b.{c}") + F.col(f"b.{s}") + gap < F.col(f"a.{c}"))
        links = settled(a.join(b, same & (F.col("a.i") > F.col("b.i")) & ~apart("x", "w") & ~apart("y", "h")).select(F.col("a.i").alias("u"), F.col("b.i").alias("v")).distinct(), "links")
        if links.isEmpty():
            return now.drop("i")
        named = now.join(united(links).withColumnRenamed("node", "i"), "i", "left").withColumn("i", F.coalesce("root", "i"))
        grown = named.groupBy(*by, "i").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.sum("area").alias("area"))
        now = settled(grown, "boxes")
    raise RuntimeError("boxes didn't settle")
