"""Queries over pixels. An embedding is a tile of 8 by 8 pixels: its numbers give red, from the end green, and from the middle blue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image, screening
from ..operators import regions
from .catalogue import query, table


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda v: F.floor(F.least(F.greatest(v.cast("double") * 1.5 + 0.5, F.lit(0.0)), F.lit(0.999)) * 256).cast("int")
    at = lambda i: F.element_at("embedding", i.cast("int"))
    pixel = lambda i: F.array(byte(at(i)), byte(at(65 - i)), byte(at((i + 31) % 64 + 1)))
    flat = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(64)), pixel))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("slide"), flat.alias("pixels"), F.lit(8).alias("side"))


_BYTE = "floor(least(greatest(embedding[{}]::DOUBLE * 1.5 + 0.5, 0), 0.999) * 256)"
_PIXELS = f"""WITH px AS (SELECT vec_id, i, (i - 1) % 8 AS x, (i - 1) // 8 AS y, {_BYTE.format("i")} AS r, {_BYTE.format("65 - i")} AS g, {_BYTE.format("(i + 31) % 64 + 1")} AS b FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
"""


@query(_PIXELS + """, gy AS (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS v FROM px), st AS (SELECT *, abs(lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - v) / 255 AS dx, abs(lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - v) / 255 AS dy FROM gy)
SELECT vec_id, round(avg(v), 6) AS gray, round((avg(dx) + avg(dy)) / 2, 6) AS texture FROM st GROUP BY vec_id HAVING avg(v) < 140 AND (avg(dx) + avg(dy)) / 2 >= 0.1""")
def foreground_tiles(spark, sf_dir):
    """Tiles under a brightness and over a texture cut-off."""
    rows = _tiles(spark, sf_dir).select("vec_id", screening.foreground_metrics("pixels", "side").alias("m"))
    kept = rows.filter((F.col("m.gray") < 140) & (F.col("m.texture") >= 0.1))
    return kept.select("vec_id", F.round("m.gray", 6).alias("gray"), F.round("m.texture", 6).alias("texture"))


_SCREEN_NAMES = ["tissue_fraction", "purple_fraction", "purple_strength", "red_fraction", "gray_cluster_fraction", "dark_fraction", "extreme_saturation_fraction", "color_entropy"]


@query(_PIXELS + """, f AS (SELECT *, r / 255 AS fr, g / 255 AS fg, b / 255 AS fb FROM px), c AS (SELECT *, fr * 0.299 + fg * 0.587 + fb * 0.114 AS gray, greatest(fr, fg, fb) - least(fr, fg, fb) AS ch, greatest(0.55 * fb + 0.35 * fr - 0.75 * fg, 0) AS p FROM f),
t AS (SELECT *, gray < 0.93 AND (ch > 0.035 OR gray < 0.82) AS t, floor(r * 8 / 256) * 64 + floor(g * 8 / 256) * 8 + floor(b * 8 / 256) AS q FROM c),
h AS (SELECT vec_id, sum(n * log2(n)) AS s, sum(n) AS n FROM (SELECT vec_id, q, count(*) AS n FROM t WHERE t GROUP BY ALL) GROUP BY vec_id)
SELECT t.vec_id, round(avg(t::INTEGER), 9) AS tissue_fraction, round(avg((t AND p > 0.04)::INTEGER), 9) AS purple_fraction, round(avg(p) FILTER (t), 9) AS purple_strength, round(avg((t AND fr - greatest(fg, fb) > 0.05)::INTEGER), 9) AS red_fraction,
round(avg((t AND gray < 0.72 AND ch < 0.12)::INTEGER), 9) AS gray_cluster_fraction, round(avg((t AND gray < 0.24)::INTEGER), 9) AS dark_fraction, round(avg((t AND ch > 0.55)::INTEGER), 9) AS extreme_saturation_fraction,
round((log2(any_value(h.n)) - any_value(h.s) / any_value(h.n)) / 9, 9) AS color_entropy FROM t JOIN h ON t.vec_id = h.vec_id GROUP BY t.vec_id""")
def screening_metrics(spark, sf_dir):
    rows = _tiles(spark, sf_dir).select("vec_id", screening.screening_metrics("pixels", "side").alias("m"))
    return rows.select("vec_id", *[F.round(f"m.{c}", 9).alias(c) for c in _SCREEN_NAMES])


_METRIC_NAMES = [
    "coarse_score", "tissue_fraction", "purple_fraction", "rbc_fraction", "eosinophilic_cellular_fraction", "gray_black_fraction", "artifact_fraction", "brightness", "saturation", "stain_strength", "hematoxylin", "edge_density",
    "focus", "focus_energy", "nuclear_fraction", "nuclear_detail", "packed_nuclear_fraction", "purple_cellular_fraction", "dark_cellular_fraction", "very_dark_fraction", "dark_in_focus_fraction", "empty_fraction", "nucleated_to_red_ratio",
]
_CELLULAR = "gray < {1} AND gray > {0} AND ch > {2} AND s >= greatest({3}, fl * {4}) AND e > {5} AND blue"


_EDGES = _PIXELS.rstrip() + """, f AS (SELECT *, r / 255 AS fr, g / 255 AS fg, b / 255 AS fb FROM px),
o AS (SELECT *, fr * 0.299 + fg * 0.587 + fb * 0.114 AS gray, greatest(fr, fg, fb) - least(fr, fg, fb) AS ch, -ln(greatest(fr, 1 / 255.0::DOUBLE)) AS dr, -ln(greatest(fg, 1 / 255.0::DOUBLE)) AS dg, -ln(greatest(fb, 1 / 255.0::DOUBLE)) AS db FROM f),
n AS (SELECT *, greatest(dr * 0.35 + dg * -0.55 + db * 0.65, 0) AS s, lead(gray, 1, gray) OVER u AS gr, lag(gray, 1, gray) OVER u AS gl, lead(gray, 1, gray) OVER v AS gd, lag(gray, 1, gray) OVER v AS gu FROM o WINDOW u AS (PARTITION BY vec_id, y ORDER BY x), v AS (PARTITION BY vec_id, x ORDER BY y)),
e AS (SELECT *, abs(gr - gray) AS dx, abs(gd - gray) AS dy, abs(gr - gray) + abs(gd - gray) AS e, gl + gr + gu + gd - 4 * gray AS l, fr - greatest(fg, fb) AS rl, fb >= fr - 0.06 AS blue FROM n)
"""


@query(_EDGES.rstrip() + f""", p AS (SELECT vec_id, greatest(0.05, quantile_cont(s, 0.7)) AS fl, greatest(0.05, quantile_cont(e, 0.7)) AS ef, least(greatest(ln(1 + var_pop(l) * 256) / ln(4), 0), 1) AS proxy FROM e GROUP BY vec_id),
k AS (SELECT e.*, fl, ef, proxy, s >= fl AS nu FROM e JOIN p ON e.vec_id = p.vec_id),
bx AS (SELECT a.vec_id, a.i, avg(c.nu::INTEGER) AS m FROM k a, (SELECT unnest([-1, 0, 1]) AS oy) y0, (SELECT unnest([-1, 0, 1]) AS ox) x0, k c WHERE c.vec_id = a.vec_id AND c.x = least(greatest(a.x + ox, 0), 7) AND c.y = least(greatest(a.y + oy, 0), 7) GROUP BY a.vec_id, a.i),
m AS (SELECT k.*, bx.m AS packed FROM k JOIN bx ON k.vec_id = bx.vec_id AND k.i = bx.i),
a AS (SELECT vec_id, any_value(proxy) AS proxy, avg((gray < 0.85 OR ch > 0.05 OR e > 0.02 OR s > 0.05)::INTEGER) AS tissue_fraction, avg((gray < 0.72 AND ch > 0.08 AND s >= 0.08 AND e > 0.03 AND blue)::INTEGER) AS purple_fraction,
avg(((gray < 0.78 AND rl > 0.05 AND e < 0.06 AND s < 0.06) OR (gray < 0.70 AND rl > 0.05 AND ch > 0.08 AND e < 0.045 AND s < 0.06) OR (gray < 0.62 AND rl > 0.06 AND ch < 0.12))::INTEGER) AS rbc_fraction,
avg((gray < 0.74 AND gray > 0.28 AND ch > 0.10 AND s >= 0.05 AND e > 0.045 AND fr >= fb - 0.03 AND fr <= fb + 0.18)::INTEGER) AS eosinophilic_cellular_fraction,
avg(((gray < 0.40 AND ch < 0.10 AND e < 0.05) OR (gray < 0.52 AND ch < 0.08 AND (e < 0.04 OR s < 0.06)))::INTEGER) AS gray_black_fraction,
avg(((ch > 0.45 AND ((fb > 0.62 AND fr < 0.58) OR (fg > 0.65 AND fr < 0.58) OR (fr > 0.74 AND fg < 0.5 AND fb < 0.5))) OR (gray < 0.08 AND ch < 0.15 AND e < 0.03) OR (gray < 0.22 AND e < 0.025) OR (gray < 0.55 AND s >= greatest(0.08, fl) AND e < 0.02))::INTEGER) AS artifact_fraction,
avg(gray) AS brightness, avg(ch) AS saturation, avg(dr + dg + db) / 3 AS stain_strength, avg(s) AS hematoxylin, avg((e > 0.08)::INTEGER) AS edge_density, var_pop(l) AS focus, avg(dx * dx + dy * dy) AS focus_energy, avg(nu::INTEGER) AS nuclear_fraction,
avg(e) FILTER (nu) AS nuclear_detail, avg((nu AND packed >= 0.28 AND e > 0.03)::INTEGER) AS packed_nuclear_fraction, avg(({_CELLULAR.format(0.18, 0.72, 0.08, 0.05, 0.85, 0.04)})::INTEGER) AS purple_cellular_fraction,
avg(({_CELLULAR.format(0.18, 0.60, 0.10, 0.05, 0.90, 0.05)})::INTEGER) AS dark_cellular_fraction, avg(({_CELLULAR.format(0.18, 0.45, 0.10, 0.08, 0.95, 0.04)})::INTEGER) AS very_dark_fraction,
avg((gray < 0.50 AND gray > 0.20 AND ch > 0.08 AND s >= greatest(0.10, fl * 0.90) AND e >= ef AND blue AND proxy >= 0.28)::INTEGER) AS dark_in_focus_fraction, avg((gray > 0.82 AND s < 0.03)::INTEGER) AS empty_fraction FROM m GROUP BY vec_id),
z AS (SELECT *, 0.26 * tissue_fraction + 0.28 * purple_fraction + 0.06 * eosinophilic_cellular_fraction + 0.15 * proxy - 0.16 * rbc_fraction - 0.15 * artifact_fraction - 0.18 * gray_black_fraction AS coarse_score,
    least(greatest(purple_cellular_fraction / greatest(purple_cellular_fraction + rbc_fraction + 0.02, 1e-6), 0), 1) AS nucleated_to_red_ratio FROM a)
SELECT vec_id, {", ".join(f"round({c}, 9) AS {c}" for c in _METRIC_NAMES)} FROM z""")
def tile_pixel_metrics(spark, sf_dir):
    rows = _tiles(spark, sf_dir).select("vec_id", screening.tile_metrics("pixels", "side").alias("m"))
    return rows.select("vec_id", *[F.round(f"m.{c}", 9).alias(c) for c in _METRIC_NAMES])


@query(_EDGES.rstrip() + """, t AS (SELECT *, gray < 0.85 OR ch > 0.05 OR e > 0.02 OR s > 0.05 AS t FROM e),
b AS (SELECT vec_id, avg(gray) * 255 AS gray, avg(t::INTEGER) AS m, [avg(t::INTEGER) FILTER (y < 4), avg(t::INTEGER) FILTER (y >= 4), avg(t::INTEGER) FILTER (x < 4), avg(t::INTEGER) FILTER (x >= 4)] AS sides,
    [avg(t::INTEGER) FILTER (y < 4 AND x < 4), avg(t::INTEGER) FILTER (y < 4 AND x >= 4), avg(t::INTEGER) FILTER (y >= 4 AND x < 4), avg(t::INTEGER) FILTER (y >= 4 AND x >= 4)] AS q FROM t GROUP BY vec_id),
c AS (SELECT *, m > 0.03 AND m < 0.995 AS mixed FROM b),
d AS (SELECT vec_id, gray, CASE WHEN mixed THEN 4 * m * (1 - m) ELSE 0 END AS contact, mixed AND ((len(list_filter(sides, lambda v: v > 0.05 AND v < 0.95)) > 0 AND m BETWEEN 0.08 AND 0.92)
    OR (1 - m >= 0.04 AND list_min(q) <= 0.65) OR (1 - m >= 0.02 AND list_min(q) <= 0.35) OR (list_min(sides) <= 0.20 AND list_max(sides) >= 0.80)) AS touches FROM c)
SELECT vec_id, round(contact, 9) AS contact FROM d WHERE gray < 226 AND NOT touches""")
def obvious_tiles(spark, sf_dir):
    """Tiles that are neither pale nor on tissue's border, with how mixed their border is."""
    rows = _tiles(spark, sf_dir).select("vec_id", screening.tile_metrics("pixels", "side").alias("m"), screening.foreground_metrics("pixels", "side")["gray"].alias("gray"))
    kept = screening.obvious_tiles(rows.select("vec_id", "gray", "m.*"))
    return kept.select("vec_id", F.round("tissue_edge_contact", 9).alias("contact"))


@query(_PIXELS + """, gy AS (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS v FROM px), d AS (SELECT *, CASE WHEN x = 0 THEN lead(v) OVER u - v WHEN x = 7 THEN v - lag(v) OVER u ELSE (lead(v) OVER u - lag(v) OVER u) / 2 END AS dx,
CASE WHEN y = 0 THEN lead(v) OVER w - v WHEN y = 7 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS dy,
    greatest(-ln(greatest(r / 255, 1 / 255.0::DOUBLE)) * 0.35 + -ln(greatest(g / 255, 1 / 255.0::DOUBLE)) * -0.55 + -ln(greatest(b / 255, 1 / 255.0::DOUBLE)) * 0.65, 0) AS s FROM gy WINDOW u AS (PARTITION BY vec_id, y ORDER BY x), w AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, round(avg(dx * dx + dy * dy), 4) AS focus, round(avg(s), 6) AS h_mean FROM d GROUP BY vec_id""")
def detail_metrics(spark, sf_dir):
    rows = _tiles(spark, sf_dir).select("vec_id", screening.detail_metrics("pixels", "side").alias("m"))
    return rows.select("vec_id", F.round("m.focus", 4).alias("focus"), F.round("m.h_mean", 6).alias("h_mean"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("slide", "vec_id", screening.tile_metrics("pixels", "side").alias("m"))


@query()
def dark_informative_scores(spark, sf_dir):
    return _measured(spark, sf_dir).select("vec_id", F.round(screening.dark_score(F.col("m")), 6).alias("score"))


@query()
def tile_cascade(spark, sf_dir):
    """Which tiles of a slide the rejection cascade and the ranking of its pool keep."""
    rows = _measured(spark, sf_dir).select("slide", "vec_id", "m.*")
    return screening.select_tiles(rows, ["slide"], "vec_id").select("slide", "vec_id", F.round("combined", 6).alias("combined"), "kept_as")


@query(_PIXELS + """, f AS (SELECT *, r / 255 AS fr, g / 255 AS fg, b / 255 AS fb, (r * 0.299 + g * 0.587 + b * 0.114) / 255 AS gray FROM px),
n AS (SELECT *, lead(gray, 1, gray) OVER u + lag(gray, 1, gray) OVER u + lead(gray, 1, gray) OVER v + lag(gray, 1, gray) OVER v - 4 * gray AS l FROM f WINDOW u AS (PARTITION BY vec_id, y ORDER BY x), v AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, round(avg((gray < 0.22 AND greatest(fr, fg, fb) - least(fr, fg, fb) > 0.18 AND fb > fr + 0.15 AND fb > fg + 0.05 AND abs(l) < 0.05)::INTEGER), 6) AS flood FROM n GROUP BY vec_id HAVING avg((gray < 0.22 AND greatest(fr, fg, fb) - least(fr, fg, fb) > 0.18 AND fb > fr + 0.15 AND fb > fg + 0.05 AND abs(l) < 0.05)::INTEGER) <= 0.40""")
def flooded_tiles_dropped(spark, sf_dir):
    rows = _tiles(spark, sf_dir).select("vec_id", F.round(screening.flood_fraction("pixels", "side")["flood"], 6).alias("flood"))
    return rows.filter("flood <= 0.40")


@query(_PIXELS + """, gy AS (SELECT vec_id, r * 0.299 + g * 0.587 + b * 0.114 AS v, r, g, b FROM px), h AS (SELECT vec_id, count(*) AS n FROM gy GROUP BY vec_id, least(greatest(floor(v), 0), 255))
SELECT gy.vec_id, round(avg((v < 240)::INTEGER), 6) AS tissue, round(avg((v < 100)::INTEGER), 6) AS dark, round(any_value(e), 6) AS entropy FROM gy JOIN (SELECT vec_id, 6 - sum(n * log2(n)) / 64 AS e FROM h GROUP BY vec_id) x ON gy.vec_id = x.vec_id GROUP BY gy.vec_id""")
def plain_tile_metrics(spark, sf_dir):
    rows = _tiles(spark, sf_dir).select("vec_id", image.tile_metrics("pixels", "side").alias("m"))
    return rows.select("vec_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("tissue", "dark", "entropy")])


def _parts_sql(group: str, y: str, x: str, least: int) -> str:
    """Boxes of connected pixels: each pixel takes the least place around it, step by step, for as many steps as a part may be long."""
    return f"""WITH RECURSIVE px AS MATERIALIZED (SELECT {group} AS g, {y} AS y, {x} AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64) WHERE embedding[i + 1] > 0.05),
nb AS MATERIALIZED (SELECT a.g, a.y, a.x, b.y AS ny, b.x AS nx FROM (SELECT px.*, unnest([[0, 0], [0, 1], [0, -1], [1, 0], [-1, 0]]) AS o FROM px) a JOIN px b ON a.g = b.g AND b.y = a.y + o[1] AND b.x = a.x + o[2]),
r AS (SELECT 0 AS step, g, y, x, y * 1000 + x AS l FROM px UNION ALL SELECT step + 1, nb.g, nb.y, nb.x, min(l) FROM r JOIN nb ON r.g = nb.g AND r.y = nb.ny AND r.x = nb.nx WHERE step < 100 GROUP BY step, nb.g, nb.y, nb.x)
SELECT g::BIGINT AS "group", min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x) - min(x) + 1)::BIGINT AS w, (max(y) - min(y) + 1)::BIGINT AS h, count(*) AS area FROM r WHERE step = 100 GROUP BY g, l HAVING count(*) >= {least}"""


@query(_parts_sql("vec_id", "i // 8", "i % 8", 2))
def mask_parts(spark, sf_dir):
    """Connected parts of each tile's dark pixels."""
    dark = F.transform("embedding", lambda v: v > 0.05)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(image.mask_boxes(dark, F.lit(8), F.lit(2))).alias("b"))
    return rows.select(F.col("vec_id").alias("group"), *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x", "y", "w", "h", "area")])


def _mask_tiles(spark, sf_dir):
    """Eight by eight tiles a slide, the last slide as far as it goes."""
    place = F.col("vec_id") % 64
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("group"), F.floor(place / 8).alias("ty"), (place % 8).alias("tx"), F.transform("embedding", lambda v: v > 0.05).alias("mask"))


_SLIDE_PARTS = _parts_sql("vec_id // 64", "vec_id % 64 // 8 * 8 + i // 8", "vec_id % 8 * 8 + i % 8", 1)


@query(_SLIDE_PARTS)
def slide_mask_parts(spark, sf_dir):
    """Connected parts over the borders of the tiles that hold a slide's mask."""
    return regions.mask_parts(_mask_tiles(spark, sf_dir), ["group"])


@query()
def slide_dark_regions(spark, sf_dir):
    """Dark regions of overviews that are put together from 64 tiles each."""
    tiles = _tiles(spark, sf_dir).select(F.floor(F.col("vec_id") / 64).alias("slide"), (F.col("vec_id") % 64).alias("place"), F.posexplode("pixels").alias("k", "v"))
    y, x = F.floor(F.col("place") / 8) * 8 + F.floor(F.col("k") / 24), F.col("place") % 8 * 24 + F.col("k") % 24
    # an overview is 64 by 64 pixels; where a tile lacks there is glass
    places = tiles.select("slide").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(64 * 64 * 3 - 1))))
    full = places.join(tiles.select("slide", (y * 192 + x).cast("int").alias("p"), "v"), ["slide", "p"], "left")
    whole = full.groupBy("slide").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("v", F.lit(255)).alias("v")))).alias("l"))
    views = whole.select("slide", F.transform("l", lambda s: s["v"]).alias("pixels"), F.lit(64).alias("width"), F.lit(10.0).alias("scale_x"), F.lit(10.0).alias("scale_y"))
    return screening.region_boxes(views, ["slide"], least_area=60)
