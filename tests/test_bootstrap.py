"""Resampled curves and areas against plain arithmetic over the same draws."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tilecohort.operators import bootstrap, metrics


def brute(rows, samples, steps):
    """{(curve, step): (low, high)} and the areas, of rows (id, truth, score), a resample at a time."""
    x = np.array([int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:8], 16) for i, _, _ in rows], np.uint64)
    m = bootstrap.draws(x, samples).astype(int)
    curves, areas = {"roc": [], "pr": []}, []
    grid = np.arange(steps) / (steps - 1)
    for s in range(samples):
        sample = [(sc, t) for (_, t, sc), k in zip(rows, m[:, s]) for _ in range(k)]
        p, n = sum(t for _, t in sample), sum(1 - t for _, t in sample)
        if not p or not n:
            continue
        fpr, tpr, recall, precision = [0.0], [0.0], [0.0], [1.0]
        for cut in sorted({sc for sc, _ in sample}, reverse=True):
            tp, fp = sum(t for sc, t in sample if sc >= cut), sum(1 - t for sc, t in sample if sc >= cut)
            fpr.append(fp / n), tpr.append(tp / p), recall.append(tp / p), precision.append(tp / (tp + fp))
        curves["roc"].append(np.interp(grid, fpr, tpr))
        curves["pr"].append(np.interp(grid, recall, precision))
        areas.append(np.trapezoid(tpr, fpr))
    return {(c, i): tuple(np.quantile([v[i] for v in vs], [0.025, 0.975])) for c, vs in curves.items() for i in range(steps)}, areas


def test_bands_and_areas_equal_resampling_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "_ROWS", 7)
    draw = random.Random(3)
    rows = [(i, int(draw.random() < 0.4), draw.choice([0.5, 0.25, round(draw.random(), 2)])) for i in range(90)]
    few = [(200, 1, 0.5), (201, 0, 0.75), (202, 0, 0.1)]
    df = spark.createDataFrame([("a", *r) for r in rows] + [(None, *r) for r in few] + [("a", 999, None, 0.3), ("a", 998, 1, None)], "g string, id long, truth int, score double")
    found = bootstrap.Resampled(df, ["g"], "id", samples=60, seed=5)
    got = {(r.g, r.curve, r.step): (r.low, r.high) for r in found.bands(steps=7).collect()}
    areas = {}
    for r in found.areas().collect():
        areas.setdefault(r.g, []).append(r.a)
    for g, part in (("a", rows), (None, few)):
        bands, want = brute(part, 60, 7)
        assert np.allclose(sorted(areas[g]), sorted(want))
        for (curve, step), pair in bands.items():
            assert np.allclose(got[g, curve, step], pair, atol=2e-6), (g, curve, step)
    assert len(got) == 2 * 2 * 7


def test_one_class_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.6)], "id long, truth int, score double")
    for rows in (df, df.filter("id < 0")):
        found = bootstrap.Resampled(rows, [], "id", samples=10)
        assert found.areas().count() == 0 and found.bands(steps=5).count() == 0


def test_curve_on_a_grid_over_ranges(spark):
    points = [(g, i / 40, (i / 40) ** 2) for g in ("a", None) for i in range(3, 38)]
    got = metrics.on_grid(spark.createDataFrame(points, "g string, x double, y double"), ["g"], "x", "y", 11).orderBy("step")
    for g in ("a", None):
        xs, ys = [p[1] for p in points if p[0] == g], [p[2] for p in points if p[0] == g]
        assert np.allclose([r.y for r in got.filter(F.col("g").eqNullSafe(g)).collect()], np.interp(np.arange(11) / 10, xs, ys), atol=1e-6)
