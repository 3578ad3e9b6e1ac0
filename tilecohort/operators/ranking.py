"""Candidate ranking within a view: filters, combined score, hints and spatial selection.

The score is column arithmetic over one window a slide. Only selections that
depend on what was selected before go through ``greedy.independent``, block by block of the slide.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .greedy import independent
from .ordered import with_group
from .scaling import zscore


@dataclass(frozen=True)
class Settings:
    # The published defaults of the ranking.
    min_dark: float = 0.02
    w_margin: float = 0.70
    w_gap: float = 0.30
    like_baseline: float = 0.40
    match_offset: float = 0.02
    match_scale: float = 0.16
    w_like: float = 0.72
    w_match: float = 0.28
    w_dark: float = 0.18
    w_base: float = 0.20
    w_prior: float = 0.26
    w_penalty: float = 0.22
    support_bonus: float = 0.06
    box_bonus: float = 0.08
    support_good: float = 0.19
    support_bad: float = 0.69
    support_like: float = 0.825
    bad_top1: float = 1.0
    bad_top1_unclear: float = 0.78
    min_gap: float = 0.025
    bad_like: float = 0.72
    bad_margin: float = -0.075
    good_margin: float = 0.015
    good_like: float = 0.66
    good_gap: float = 0.02
    border_like: float = 0.78
    border_margin: float = 0.02
    border_gap: float = 0.015
    good_only_margin: float = 0.02
    separation_of_tile: float = 0.38


DEFAULT = Settings()


def in_view(x: Column, y: Column, box: tuple[int, int, int, int]) -> Column:
    """Whether a tile's centre lies in a closed box (x, y, width, height)."""
    x0, y0, w, h = box
    return x.between(x0, x0 + w) & y.between(y0, y0 + h)


def conditional_floor(rows: DataFrame, by: list[str], keep: Column, least: int) -> DataFrame:
    """Keeps only rows that pass, but only in groups where at least ``least`` do."""
    return rows.withColumn("_keep", keep).withColumn("_n", F.count_if("_keep").over(Window.partitionBy(*by))).filter((F.col("_n") < least) | F.col("_keep")).drop("_keep", "_n")


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def strong_support(s: Settings = DEFAULT) -> Column:
    return (F.col("good_top1") >= s.support_good) & (F.col("bad_top1") <= s.support_bad) & (F.col("bad_likelihood") <= s.support_like)


def combined_score(rows: DataFrame, by: list[str], s: Settings = DEFAULT, inside_box: Column | None = None) -> DataFrame:
    """Adds ``combined``: weighted z-scores of dark, retrieval and prior, less a penalty, plus bonuses."""
    over = Window.partitionBy(*by)
    prior = s.w_margin * F.col("margin") + s.w_gap * (F.col("good_top1") - F.col("bad_top1"))
    like = clip01((F.col("bad_likelihood") - s.like_baseline) / max(1e-6, 1 - s.like_baseline))
    match = clip01((F.col("bad_top1") - F.col("good_top1") + s.match_offset) / max(1e-6, s.match_scale))
    score = s.w_dark * zscore(F.col("dark"), over) + s.w_base * zscore(F.col("retrieval"), over) + s.w_prior * zscore(prior, over) - s.w_penalty * (s.w_like * like + s.w_match * match)
    score = score + F.when(strong_support(s), s.support_bonus).otherwise(0.0)
    if inside_box is not None:
        score = score + F.when(inside_box, s.box_bonus).otherwise(0.0)
    return rows.withColumn("combined", score)


def rejected_by_reference(s: Settings = DEFAULT) -> Column:
    bad, good = F.col("bad_top1"), F.col("good_top1")
    unclear = (bad >= s.bad_top1_unclear) & (good - bad <= s.min_gap)
    return (bad >= s.bad_top1) | unclear | (F.col("bad_likelihood") >= s.bad_like) | (F.col("margin") <= s.bad_margin)


def quality_hint(good_only: bool = False, s: Settings = DEFAULT) -> Column:
    """good_like, bad_like or uncertain."""
    if good_only:
        return F.when(F.col("margin") > s.good_only_margin, "good_like").otherwise("uncertain")
    strong = strong_support(s)
    good = (F.col("margin") > s.good_margin) & (F.col("bad_likelihood") < s.good_like) & (F.col("good_top1") >= F.col("bad_top1") + s.good_gap)
    border = (F.col("bad_likelihood") >= s.border_like) & (F.col("margin") <= s.border_margin) & (F.col("good_top1") <= F.col("bad_top1") + s.border_gap)
    bad = ((F.col("margin") <= s.bad_margin) | border) & ~strong
    return F.when(rejected_by_reference(s) & ~strong, "bad_like").when(good, "good_like").when(bad, "bad_like").otherwise("uncertain")


def top_k(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k of each group, numbered from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def rank_order(id_: str = "id") -> list[Column]:
    """Order of candidates: hint, good similarity, retrieval, base score; ties to the smaller id."""
    bonus = F.when(F.col("hint") == "good_like", 1.0).when(F.col("hint") == "bad_like", 0.0).otherwise(0.5)
    return [bonus.desc(), F.coalesce("good_top1", F.lit(0.0)).desc(), F.coalesce("retrieval", F.lit(0.0)).desc(), F.col("combined").desc_nulls_last(), F.col(id_)]


def two_pools(rows: DataFrame, by: list[str], cap: int, id_: str = "id") -> DataFrame:
    """Hides bad_like candidates where a group has any other, else keeps its first one."""
    numbered = rows.withColumn("_other", F.bool_or(F.col("hint") != "bad_like").over(Window.partitionBy(*by))).filter(~F.col("_other") | (F.col("hint") != "bad_like"))
    return top_k(numbered, by, cap, *rank_order(id_)).filter(F.col("_other") | (F.col("rank") == 1)).drop("_other")


def separation(least: float, tile: Column | float, s: Settings = DEFAULT) -> Column:
    """How far selected centres of tiles of a size must lie apart."""
    return F.greatest(F.lit(float(least)), F.round(F.lit(s.separation_of_tile) * tile))


def _first(rows: DataFrame, by: list[str], k: Column | int, name: str, *order: Column) -> DataFrame:
    """The first k rows of each group (null keys are one), numbered from 1 in ``name``."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k)
    return numbered.withColumn(name, F.col("_n").cast(rows.schema[name].dataType) if name in rows.columns else F.col("_n")).drop("_n")


def suppress(rows: DataFrame, by: list[str], apart: float, k: int, order: str = "rank") -> DataFrame:
    """Greedy spatial suppression in order: a candidate nearer than ``apart`` to a taken one is passed over, until k are taken.

    Ranks are numbered anew. Null keys are one group, and so are all rows if there are no keys; a candidate without a place is never taken.
    """
    down = [F.col(order), F.col("id")]
    taken = independent(rows, by, "cx", "cy", apart, *down).filter("taken").drop("taken")
    return _first(taken, by, k, order, *down).select(*rows.columns)


def diversify(rows: DataFrame, by: list[str], visited: list[tuple[float, float]], apart: float, visited_apart: float, least: int, k: int) -> DataFrame:
    """Drops candidates near visited centres unless fewer than ``least`` stay, spaces the others out, then fills up to ``least``.

    Null keys are one group, and so are all rows if there are no keys; a candidate without a place counts as near a visited centre and only fills up.
    """
    near = [(F.col("cx") - x) ** 2 + (F.col("cy") - y) ** 2 < visited_apart**2 for x, y in visited]
    free = F.coalesce(~reduce(lambda a, b: a | b, near), F.lit(False)) if near else F.lit(True)
    counts = rows.groupBy(*by).agg(F.count_if(free).alias("_free"))
    pool = with_group(rows, counts, by).filter((F.col("_free") < least) | free).select(*rows.columns)
    down = [F.col("rank"), F.col("id")]
    found = independent(pool, by, "cx", "cy", apart, *down)
    # the first k taken come before the fill, which is there only if fewer than ``least`` are taken
    taken = _first(found.filter("taken"), by, k, "rank", *down)
    spare = _first(found.filter("NOT taken"), by, max(0, min(least, k)), "rank", *down)
    both = taken.withColumn("_fill", F.lit(0)).unionByName(spare.withColumn("_fill", F.lit(1)))
    numbered = both.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_fill", "rank")))
    kind = rows.schema["rank"].dataType
    return numbered.filter((F.col("_fill") == 0) | (F.col("_n") <= min(least, k))).withColumn("rank", F.col("_n").cast(kind)).select(*rows.columns)


def next_unattempted(rows: DataFrame, attempted: DataFrame, by: list[str], apart: float) -> DataFrame:
    """The lowest rank of each group whose centre is far enough from all attempted boxes (x, y, w, h) of that group.

    A box keeps off what is nearer to its centre than ``apart`` or half its longer side.
    """
    side = F.greatest(F.col("w"), F.col("h"), F.lit(1))
    middle = lambda c, s: F.col(c) + F.floor(F.greatest(F.col(s), F.lit(1)) / 2)
    tried = attempted.select(*[F.col(c).alias(f"_{c}") for c in by], middle("x", "w").alias("ax"), middle("y", "h").alias("ay"), F.greatest(F.lit(float(apart)), side * 0.5).alias("radius"))
    near = (F.col("cx") - F.col("ax")) ** 2 + (F.col("cy") - F.col("ay")) ** 2 < F.col("radius") ** 2
    for c in by:
        near = near & (F.col(c) == F.col(f"_{c}"))
    return rows.join(tried, near, "left_anti").groupBy(*by).agg(F.min("rank").alias("rank"))


def inside_any(x: Column, y: Column, boxes: Column) -> Column:
    """Whether a point lies in any box of an array of (x, y, w, h), borders included."""
    return F.coalesce(F.exists(boxes, lambda b: x.between(b["x"], b["x"] + b["w"]) & y.between(b["y"], b["y"] + b["h"])), F.lit(False))


def masked(rows: DataFrame, by: list[str], mask: str) -> DataFrame:
    """Keeps rows whose mask is set, in groups where any is; other groups stay whole."""
    return rows.withColumn("_any", F.bool_or(mask).over(Window.partitionBy(*by))).filter(~F.coalesce("_any", F.lit(False)) | F.col(mask)).drop("_any")


def evidence(near: DataFrame, references: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """(by, id, class, refs): up to ``most`` nearest references of each class with similarity and rank, the nearest first.

    ``near`` has (id, ref, sim); ``references`` (ref, class). A tile without a reference of a class has no row for it.
    """
    full = near.join(references, "ref")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "id", "class").orderBy(F.desc("sim"), "ref"))).filter(F.col("rank") <= most)
    return ranked.groupBy(*by, "id", "class").agg(F.array_sort(F.collect_list(F.struct("rank", "ref", "sim"))).alias("refs"))


def nominated(near: DataFrame, most: int) -> DataFrame:
    """The inverted index of references' nearest tiles (ref, tile, sim): (tile, n, refs), refs the ``most`` nearest of a tile with similarity."""
    order = Window.partitionBy("tile").orderBy(F.desc("sim"), "ref")
    ranked = near.withColumn("rank", F.row_number().over(order))
    kept = F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "ref", "sim")))
    return ranked.groupBy("tile").agg(F.count("*").alias("n"), F.array_sort(kept).alias("refs"))


def view_box(cx: Column, cy: Column, tile: Column, view: tuple[int, int, int, int], least: int = 10) -> Column:
    """(x, y, x0, y0, x1, y1) of a tile in a view (x, y, w, h) scaled to 0..999; half a box is ``least`` wide at least."""
    vx, vy, vw, vh = view
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(999)).cast("int")
    scale = lambda v, origin, size: clamp(F.bround((v - origin) / float(max(1, size)) * 999))
    x, y = scale(cx, vx, vw), scale(cy, vy, vh)
    half = lambda size: F.greatest(F.bround(tile / 2.0 / float(max(1, size)) * 999), F.lit(least)).cast("int")
    hx, hy = half(vw), half(vh)
    return F.struct(x.alias("x"), y.alias("y"), clamp(x - hx).alias("x0"), clamp(y - hy).alias("y0"), clamp(x + hx).alias("x1"), clamp(y + hy).alias("y1"))
