"""Which supertiles and tiles are kept, and where regions and fields are placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clinical import hashed_order
from .greedy import independent
from .ordered import quantiles, with_group
from .scaling import unit_scale


def separated(cells: DataFrame, by: list[str], score: str, keep: str) -> DataFrame:
    """Greedy choice of ``keep`` grid cells (gx, gy) a group by score, apart by Chebyshev distance, filled up by score.

    Cells lie two apart where the group has more than twice as many as it keeps, else any distinct ones do.
    Ties go to the upper, then the left cell. ``keep`` is a column that is constant in a group.
    """
    # merged: cells made by an explode look small, and would be broadcast
    sized = with_group(cells, cells.groupBy(*by).agg(F.count("*").alias("_all")).hint("merge"), by)
    down = [F.desc(score), F.col("gy"), F.col("gx")]
    apart = F.when(F.col("_all") > 2 * F.col(keep), 2).otherwise(1)
    found = independent(sized, by, "gx", "gy", apart, *down, square=True)
    # the taken ones come first, and the others fill up
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("taken"), *down))
    return found.withColumn("_n", place).filter(F.col("_n") <= F.col(keep)).select(*cells.columns)


def dark_keep_count(n: Column, overlapping: Column) -> Column:
    """Supertiles kept under guidance by dark boxes: 12, 18 % of more than 48, or half again as many as overlap a box; never more than there are."""
    share = F.when(n > 48, F.ceil(n * 0.18)).otherwise(0)
    return F.greatest(F.least(n, F.greatest(F.lit(12), share, F.ceil(F.greatest(overlapping, F.lit(1)) * 1.5))), F.lit(1)).cast("int")


def keep_with_reserve(rows: DataFrame, by: list[str], score: str, key: str, ratio: float, least: int, reserve: float, trigger: int, seed: int = 0) -> DataFrame:
    """The best max(least, ceil(ratio n)) of a pool and a share of the others by hash; pools up to ``trigger`` stay whole.

    ``kept_as`` says top, reserve or all. Ties go to the smaller key.
    """
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), key)))
    top = F.least(F.greatest(F.lit(least), F.ceil(F.col("_n") * ratio)), F.col("_n"))
    spare = F.least(F.ceil(F.col("_n") * reserve), F.col("_n") - top)
    cut = placed.withColumn("_top", top).withColumn("_spare", spare)
    drawn = cut.withColumn("_d", F.row_number().over(Window.partitionBy(*by, F.col("_r") > F.col("_top")).orderBy(hashed_order(F.col(key), seed), key)))
    how = F.when(F.col("_n") <= max(1, trigger), "all").when(F.col("_r") <= F.col("_top"), "top").when(F.col("_d") <= F.col("_spare"), "reserve")
    return drawn.withColumn("kept_as", how).filter("kept_as IS NOT NULL").drop("_n", "_r", "_top", "_spare", "_d")


def prefilter(rows: DataFrame, by: list[str], screen: str, key: str, details: dict[str, float], keep: float = 0.30, reserve: float = 0.05, percentile: float = 10.0, seed: int = 0) -> DataFrame:
    """Tiles that a screening keeps, ranked anew with detailed metrics.

    Tiles under a percentile of the screening score fall out; the best share of the others stays, and of those
    that fell out a share of all tiles by hash. The final score is 0.70 of the screening's and 0.30 of the weighted
    details, each scaled between its 5th and 95th percentile among what stays.
    """
    floor = quantiles(rows, by, screen, _floor=percentile / 100)
    n = rows.groupBy(*by).agg(F.count("*").alias("_all"))
    placed = with_group(rows, with_group(floor, n, by), by).withColumn("_up", F.col(screen) >= F.col("_floor"))
    w = Window.partitionBy(*by, "_up")
    cut = placed.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc(screen), key)), "_d": F.row_number().over(w.orderBy(hashed_order(F.col(key), seed), key))})
    stays = cut.filter(F.when(F.col("_up"), F.col("_r") <= F.greatest(F.ceil(F.col("_n") * keep), F.lit(1))).otherwise(F.col("_d") <= F.ceil(F.col("_all") * reserve)))
    out = stays.select(*rows.columns)
    for c in (screen, *details):
        out = unit_scale(out, by, c, f"_{c}", 0.05, 0.95, fall_back_to_range=False)
    mix = sum((F.col(f"_{c}") * w for c, w in details.items()), F.lit(0.0))
    score = F.least(F.greatest(0.70 * F.col(f"_{screen}") + 0.30 * mix, F.lit(0.0)), F.lit(1.0))
    scored = out.withColumn("score", F.round(score, 6)).drop(*[f"_{c}" for c in (screen, *details)])
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key)))


def _clamped(origin: Column, size: Column, end: Column) -> Column:
    return F.greatest(F.least(origin, end - size), F.lit(0))


def half(size: Column) -> Column:
    return F.floor(size / 2)


def candidate_field(cx: Column, cy: Column, width_um: float, mpp: Column, least: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h, enlarged) of the field around a candidate: as many micrometres wide, inside the slide, and at least a region's size."""
    side = F.greatest(F.bround(F.lit(width_um) / F.greatest(mpp, F.lit(1e-6))), F.lit(1)).cast("long")
    x, y = (_clamped(F.bround(c).cast("long") - half(side), side, end) for c, end in ((cx, width), (cy, height)))
    grown = F.greatest(side, least)
    # an enlarged field keeps the middle of the one before
    moved = lambda o, end: F.when(grown == side, o).otherwise(_clamped(o + half(side) - half(grown), grown, end))
    return F.struct(moved(x, width).cast("long").alias("x"), moved(y, height).cast("long").alias("y"), grown.cast("long").alias("w"), grown.cast("long").alias("h"), (grown != side).alias("enlarged"))


def region_crop(box: tuple[Column, Column, Column, Column], view: tuple[Column, Column, Column, Column], size: Column, width: Column, height: Column) -> Column:
    """(x, y) of a square crop for a box given in 0..999 of a view (x, y, w, h): centred on it, moved to hold it, inside the slide."""

    def axis(a: Column, b: Column, origin: Column, extent: Column, end: Column) -> Column:
        unit = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(999)) / 999.0
        low, high = (origin + F.bround(unit(f(a, b)) * extent) for f in (F.least, F.greatest))
        middle = low + half(F.greatest(high - low, F.lit(1)))
        held = F.greatest(F.least(middle - half(size), low), high - size)
        return _clamped(held, size, end).cast("long")

    return F.struct(axis(box[0], box[2], view[0], view[2], width).alias("x"), axis(box[1], box[3], view[1], view[3], height).alias("y"))


def fresh_regions(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """Regions (cx, cy) in order of ``rank`` that aren't within half a size of one accepted before."""
    return independent(rows, by, "cx", "cy", 0.5 * size, F.col("rank"), F.col("id")).filter("taken").drop("taken")


def box_of_view(x0: Column, y0: Column, x1: Column, y1: Column, view: tuple[Column, Column, Column, Column], width: Column, height: Column, shrink: float = 0.35, aspect: float = 1.4) -> Column:
    """(x, y, w, h) on the slide of a box in 0..999 of a view.

    A side over 0.7 of the view's shrinks the box about its middle, the box is cut to the slide, and its longer
    side is cut to ``aspect`` times the shorter.
    """
    unit = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(999)) / 999.0
    vx, vy, vw, vh = view
    ends = [(F.least(unit(a), unit(b)), F.greatest(unit(a), unit(b))) for a, b in ((x0, x1), (y0, y1))]
    start = [o + F.bround(lo * s) for (lo, _), o, s in zip(ends, (vx, vy), (vw, vh))]
    size = [F.greatest(F.bround((hi - lo) * s), F.lit(1.0)) for (lo, hi), s in zip(ends, (vw, vh))]
    large = (size[0] / vw > 0.7) | (size[1] / vh > 0.7)
    small = [F.greatest(F.bround(s * shrink), F.lit(32.0)) for s in size]
    start = [F.when(large, o + half(s) - half(t)).otherwise(o) for o, s, t in zip(start, size, small)]
    size = [F.when(large, t).otherwise(s) for s, t in zip(size, small)]
    start = [F.greatest(F.least(o, e - 1), F.lit(0)) for o, e in zip(start, (width, height))]
    size = [F.greatest(F.least(s, e - o), F.lit(1)) for s, o, e in zip(size, start, (width, height))]
    out = []
    for k, (o, s, e) in enumerate(zip(start, size, (width, height))):
        other = size[1 - k]
        cut = F.greatest(F.bround(other * aspect), F.lit(1))
        long = s / other > aspect
        out.append((F.when(long, _clamped(o + half(s) - half(cut), cut, e)).otherwise(o), F.when(long, cut).otherwise(s)))
    return F.struct(*[v.cast("long").alias(n) for v, n in zip((out[0][0], out[1][0], out[0][1], out[1][1]), ("x", "y", "w", "h"))])


def grid_place(x_um: Column, y_um: Column, stride: Column) -> Column:
    """(column, row) of a tile on the grid of a slide."""
    return F.struct(F.bround(x_um / stride).cast("long").alias("gx"), F.bround(y_um / stride).cast("long").alias("gy"))


def inclusion_map(tiles: DataFrame, slide: str, x: str, y: str, size: float, kept: str) -> DataFrame:
    """(slide, gx, gy, included): grid cells that hold tiles, and whether a kept one is among them."""
    return tiles.groupBy(slide, F.floor(F.col(x) / size).alias("gx"), F.floor(F.col(y) / size).alias("gy")).agg(F.bool_or(kept).alias("included"))


def weighted_support(rows: DataFrame, by: list[str], key: str, scores: str, attention: str, place: int) -> DataFrame:
    """A class's support at each tile, times its attention: its own where it leads, else the best other class's, each over its largest of the slide."""
    others = lambda v: F.array_max(F.filter(v, lambda _, i: i != place))
    s, a = F.element_at(scores, place + 1).cast("double"), F.element_at(attention, place + 1).cast("double")
    # of equal scores the first class leads
    leads = F.array_position(F.col(scores), F.array_max(scores)) == place + 1
    placed = rows.select(*by, key, (s - others(F.col(scores))).alias("support"), leads.alias("leads"), a.alias("a"), others(F.col(attention)).cast("double").alias("o"), F.array_max(attention).cast("double").alias("m"))
    tops = placed.groupBy(*by).agg(F.max("m").alias("_m"), F.max("o").alias("_o"))
    shared = with_group(placed, tops, by).select(*by, key, "support", F.when(F.col("leads"), F.try_divide(F.col("a"), F.col("_m"))).otherwise(F.try_divide(F.col("o"), F.col("_o"))).alias("_w"))
    most = shared.groupBy(*by).agg(F.max("_w").alias("_top"))
    return with_group(shared, most, by).select(*by, key, F.round("support", 6).alias("support"), F.round(F.col("support") * F.try_divide(F.col("_w"), F.col("_top")), 6).alias("score"))
