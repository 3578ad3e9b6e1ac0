"""Greedy spatial selection in rounds over blocks against a pass in order."""

import random

import pytest
from pyspark.sql import functions as F

from tilecohort.operators import greedy, ranking, selection

SCHEMA = "slide long, id long, rank int, cx double, cy double"


def in_order(rows, apart, square=False):
    taken = []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        near = (lambda t: max(abs(r[3] - t[3]), abs(r[4] - t[4])) < apart) if square else (lambda t: (r[3] - t[3]) ** 2 + (r[4] - t[4]) ** 2 < apart**2)  # noqa: B023
        if r[3] is not None and r[4] is not None and r[4] == r[4] and not any(near(t) for t in taken):
            taken.append(r)
    return taken


@pytest.mark.parametrize("square", [False, True])
@pytest.mark.parametrize("along", [False, True])
def test_rounds_over_blocks_equal_a_pass_in_order(spark, monkeypatch, square, along):
    monkeypatch.setattr(greedy, "EDGE", 8)
    draw = random.Random(7)
    rows = []
    for slide in (1, 2, None):
        for i in range(100 if along else 400):
            x, y = (i * 3.0, draw.uniform(0, 5)) if along else (draw.uniform(-300, 300), draw.choice([draw.uniform(-300, 300), 7.0]))
            rows.append((slide, i, i if along else draw.randrange(300), x, y))
    rows += [(1, 900, 0, None, 1.0), (1, 901, 0, 1.0, float("nan")), (1, 902, 299, 5.0, 5.0), (1, 902, 299, 5.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = greedy.independent(df, ["slide"], "cx", "cy", 10.0, F.col("rank"), F.col("id"), square=square)
    assert got.count() == len(rows)
    have = sorted((str(r.slide), r.id) for r in got.filter("taken").collect())
    assert have == sorted((str(s), r[1]) for s in (1, 2, None) for r in in_order([r for r in rows if r[0] == s], 10.0, square))


def test_null_groups_and_no_keys(spark):
    rows = [(None, i, i + 1, 0.0 + i, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    for by in (["slide"], []):
        assert [(r.id, r["rank"]) for r in ranking.suppress(df, by, 100.0, 1).collect()] == [(0, 1)]
        assert [(r.id, r["rank"]) for r in ranking.suppress(df, by, 2.0, 9).orderBy("rank").collect()] == [(0, 1), (2, 2), (4, 3)]
        assert [r.id for r in ranking.diversify(df, by, [(100.0, 0.0)], 2.0, 1.0, 5, 9).orderBy("rank").collect()] == [0, 2, 4, 1, 3]
        assert [r.id for r in ranking.diversify(df, by, [], 100.0, 0.0, 0, 9).collect()] == [0]
        cells = df.select("slide", F.col("id").alias("gx"), F.lit(0).alias("gy"), (-F.col("rank")).alias("score"), F.lit(2).alias("keep"))
        assert [r.gx for r in selection.separated(cells, by, "score", "keep").orderBy("gx").collect()] == [0, 2]
        assert [r.id for r in selection.fresh_regions(df, by, 4).orderBy("id").collect()] == [0, 2, 4]


def test_places_missing_empty_tables_and_no_distance(spark):
    df = spark.createDataFrame([(1, 0, 1, None, 0.0), (1, 1, 2, 0.0, 0.0), (1, 2, 3, 0.0, 0.0)], SCHEMA)
    assert [r.id for r in ranking.suppress(df, ["slide"], 1.0, 5).collect()] == [1]
    assert sorted(r.id for r in ranking.suppress(df, ["slide"], 0.0, 5).collect()) == [1, 2]
    assert sorted(r.id for r in ranking.diversify(df, ["slide"], [], 1.0, 0.0, 3, 3).collect()) == [0, 1, 2]
    assert ranking.suppress(df.filter("id < 0"), ["slide"], 1.0, 5).count() == 0
    assert ranking.diversify(df.filter("id < 0"), [], [], 1.0, 0.0, 3, 3).count() == 0
