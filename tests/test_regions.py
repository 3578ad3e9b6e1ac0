"""Parts of masks over tile borders and boxes made one, against a pass over the whole."""

import random

import numpy as np

from tilecohort.functions import image, screening
from tilecohort.operators import regions


def test_parts_over_tiles_equal_one_labelling(spark):
    rng = np.random.default_rng(5)
    spiral = np.zeros((24, 24), bool)
    for i in range(0, 12, 2):
        spiral[i, i : 24 - i], spiral[i : 24 - i, 23 - i], spiral[23 - i, i : 24 - i], spiral[i + 2 : 24 - i, i] = True, True, True, True
        spiral[i + 2, i + 1 : i + 2] = True
    slides = {1: rng.random((24, 24)) < 0.5, 2: spiral, None: rng.random((24, 24)) < 0.62, 3: np.zeros((24, 24), bool)}
    rows = []
    for slide, m in slides.items():
        for ty in range(6):
            for tx in range(4):
                rows.append((slide, ty, tx, m[ty * 4 : ty * 4 + 4, tx * 6 : tx * 6 + 6].ravel().tolist()))
    rows += [rows[0], (1, 9, 9, None), (1, None, 0, [True] * 24)]
    tiles = spark.createDataFrame(rows, "slide long, ty long, tx long, mask array<boolean>")
    got = {}
    for r in regions.mask_parts(tiles, ["slide"], height=4, width=6).collect():
        got.setdefault(r.slide, []).append((r.x, r.y, r.w, r.h, r.area))
    for slide, m in slides.items():
        assert sorted(got.get(slide, [])) == sorted(image.components(m))
    assert regions.mask_parts(tiles.filter("ty < 0"), ["slide"], height=4, width=6).count() == 0


def test_boxes_are_joined_until_none_are_near(spark):
    draw = random.Random(9)
    boxes = {g: [(x := draw.randrange(300), y := draw.randrange(300), draw.randrange(1, 30), draw.randrange(1, 30), i + 1) for i in range(60)] for g in ("a", None)}  # noqa: F841
    df = spark.createDataFrame([(g, *b) for g, bs in boxes.items() for b in bs], "slide string, x long, y long, w long, h long, area long")
    got = {}
    for r in regions.boxes_joined(df, ["slide"], 3, 32).collect():
        got.setdefault(r.slide, []).append((r.x, r.y, r.x + r.w, r.y + r.h, r.area))
    for g, bs in boxes.items():
        assert sorted(got[g]) == sorted(screening.joined([(x, y, x + w, y + h, a) for x, y, w, h, a in bs], 3))
