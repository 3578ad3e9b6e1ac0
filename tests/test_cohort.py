"""Fixtures for cohort, document and pixel operators whose results SQL can't express."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilecohort.functions import documents, screening, text
from tilecohort.operators import clinical, metrics, ordered, ranking, reports, selection, vectors
from tilecohort.sources import tables
from tilecohort.streaming import steps as streams


def test_flat_and_short_lines(spark):
    rows = spark.createDataFrame([("flat", 1.0, 2.0), ("flat", 3.0, 2.0), ("two", 1.0, 1.0), ("two", 3.0, 2.0), ("three", 1.0, 1.0), ("three", 2.0, 2.0), ("three", 4.0, 3.0)], "g string, y double, x double")
    got = {r.g: r for r in metrics.ols(rows, ["g"], "y", "x").collect()}
    assert got["flat"].slope is None and got["two"].slope == 2.0 and got["two"].stderr is None and got["three"].stderr == pytest.approx(0.288675, abs=1e-6)
    one = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0), ("b", 0, 1.0), ("c", 1, 2.0), ("c", 1, 3.0)], "g string, k int, v double")
    assert {r.g: (r.df, r.t) for r in metrics.t_statistic(one, ["g"], "k", "v").collect()} == {"a": (-1, None), "b": (0, None), "c": (0, None)}


def test_bag_of_one(spark):
    from tilecohort.operators import assembly

    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, i int")
    assert sorted((r.g, r.i, r.slot) for r in assembly.equidistant_bag(rows, ["g"], "i", 1).collect()) == [("a", 0, 0), ("b", 0, 0)]


def test_concordance_equals_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(g, int(t), int(e), float(r)) for g in ("a", "b") for t, e, r in zip(rng.integers(0, 60, 400), rng.integers(0, 2, 400), rng.integers(0, 30, 400))]
    got = {r.g: r for r in ordered.concordance(spark.createDataFrame(data, "g string, t int, e int, r double"), ["g"], "t", "e", "r").collect()}
    for g in ("a", "b"):
        own = [x[1:] for x in data if x[0] == g]
        pairs = [(a[2] > b[2], a[2] == b[2]) for a in own if a[1] for b in own if a[0] < b[0]]
        assert (got[g].won, got[g].tied) == (sum(p[0] for p in pairs), sum(p[1] for p in pairs))


def test_runs_over_many_batches(spark, tmp_path):
    """One key's shuffled rows, more than an Arrow batch: every run is right; a row out of order in a later micro-batch fails."""
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 2, 5000).tolist()
    rows = [(1, i, kinds[i], i) for i in rng.permutation(5000).tolist()]
    spark.createDataFrame(rows, "u long, t long, k int, id long").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        def run():
            stream = spark.readStream.schema("u long, t long, k int, id long").parquet(str(tmp_path / "in/*"))
            streams.running_runs(stream, "u", "t", "k", "id").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()

        run()
        got = {r.id: r.run for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        want, n = {}, 0
        for i, k in enumerate(kinds):
            n = n + 1 if i and kinds[i - 1] == k else 1
            want[i] = n
        assert got == want
        spark.createDataFrame([(1, 7, 0, 9000)], "u long, t long, k int, id long").write.parquet(str(tmp_path / "in/b"))
        with pytest.raises(Exception, match="comes before one that was counted"):
            run()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_nearest_beyond_a_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 2, [float(x) for x in rng.normal(size=8)]) for i in range(120)], "id long, slide long, vector array<float>")
    want = {(r.id, r["rank"]): r.ref for r in vectors.nearest(rows, rows, 5, skip_self=True).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 17)
    assert {(r.id, r["rank"]): r.ref for r in vectors.nearest(rows, rows, 5, skip_self=True).collect()} == want
    own = vectors.nearest(rows, rows, 5, by=["slide"], skip_self=True).collect()
    assert len(own) == 600 and all(r.id % 2 == r.ref % 2 == r.slide and r.id != r.ref for r in own)


def test_survival_status_words_and_cut_off(spark):
    rows = spark.createDataFrame([("p", "-", "dead"), ("q", "3.5", " ALIVE"), ("r", "2", None), ("s", "1", "maybe")], "patient string, t string, s string")
    assert {(r.patient, r.time, r.event) for r in clinical.survival_rows(rows.filter("patient <> 's'"), "patient", "t", "s").collect()} == {("q", 3.5, 0), ("r", 2.0, None)}
    with pytest.raises(Exception, match="unknown status"):
        clinical.survival_rows(rows, "patient", "t", "s").collect()
    known = spark.createDataFrame([("a", float(i), i % 2, float(i % 5)) for i in range(20)], "g string, t double, e int, r double")
    one = reports.survival_table(known, ["g"], "t", "e", "r", cut_off=1.0).first()
    assert (one["count"], one.events, one.censored, one.threshold) == (20, 10, 10, 1.0) and 0 < one.logrank_p <= 1


def test_raising_checks(spark):
    files = spark.createDataFrame([("d", "tile", None), ("d", "patient", "e")], "d string, feat_type string, encoder string")
    with pytest.raises(Exception, match="mixed feature types"):
        clinical.feature_type(files, ["d"]).collect()
    with pytest.raises(Exception, match="2 classes, 3 outputs"):
        clinical.declared_classes(spark.createDataFrame([("a",), ("b",)], "t string"), "t", 3).collect()
    with pytest.raises(ValueError, match="columns missing: z"):
        clinical.require_columns(files, ["d", "z"])
    none = {k: F.lit(None) for k in ("tile_size", "unit", "tile_size_um", "tile_size_px")}
    with pytest.raises(Exception, match="can't be inferred"):
        spark.range(1).select(clinical.coordinate_attributes(none, F.lit(100.0))).collect()


def test_table_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿PATIENT,x\np1,1\n")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "a.csv")).collect()] == [("p1", "1")]
    with pytest.raises(ValueError, match="no table reader"):
        tables.read_table(spark, "a.txt")
    assert tables.read_strings_or_none(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "c.csv").write_text("x,y\n1,2\nbad,4\n")
    with pytest.raises(Exception, match="bad coordinates in c.csv, line 3: bad,4"):
        tables.read_coordinates(spark, str(tmp_path / "c.csv")).collect()
    files = spark.createDataFrame([("a", "a/roi_collection.json"), ("a", "a/images/1.png"), ("b", "b/images/2.png"), ("b", "b/images/1.png"), ("c", "c/x.jpg"), ("d", "d/x.txt")], "folder string, path string")
    assert sorted(tuple(r) for r in tables.resolve_regions(files).collect()) == [("a", "manifest", "a/roi_collection.json"), ("b", "images", "b/images/1.png"), ("b", "images", "b/images/2.png"), ("c", "image", "c/x.jpg")]
    tiles = spark.createDataFrame([("/r/good/a.png",), ("/r/bad/a.PNG",), ("/r/bad/t.txt",)], "path string")
    assert {(r.path, r.label) for r in tables.labelled_tiles(tiles, {"good": "good", "bad": "bad"}).collect()} == {("/r/good/a.png", "good"), ("/r/bad/a.PNG", "bad")}


def test_tile_archives(spark, tmp_path):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("tile_(1.5, -2.0).jpg", b"x")
        z.writestr("info.json", b"{}")
    (tmp_path / "t.zip").write_bytes(data.getvalue())
    assert [(r.x_um, r.y_um, bytes(r.image)) for r in tables.archive_entries(spark, str(tmp_path / "*.zip")).collect()] == [(1.5, -2.0, b"x")]


def test_manifests(spark):
    rows = spark.createDataFrame([(json.dumps({"slide_name": "s", "accepted_rois": [{"roi_id": 1}, {"roi_id": 2}]}),), ("[]",), ("{broken",), ('{"accepted_rois": []}',)], "m string")
    got = [r.s and (r.s.slide_name, r.s.accepted) for r in rows.select(documents.manifest_summary(F.col("m")).alias("s")).collect()]
    assert got == [("s", 2), None, None, None]
    hidden = documents.without_evidence(spark.createDataFrame([(1, 0.5, 2)], "rank int, bad_margin double, x int"))
    assert hidden.columns == ["rank", "x"]


@pytest.mark.parametrize("said,want", [
    ('{"path": "/a", "b": 1}', {"b": 1}), ('{"b": {"out_dir": "x", "c": [{"d": 1, "save_dir": "y"}]}}', {"b": {"c": [{"d": 1}]}}), ('{"debug_path": "a\\"b"}', {}), ('{"paths": 1}', {"paths": 1}),
])
def test_paths_are_cut(spark, said, want):
    assert json.loads(spark.createDataFrame([(said,)], "t string").select(documents.without_paths(F.col("t")).alias("c")).first().c) == want


def test_names_and_errors(spark):
    one = spark.range(1).select(text.tool_name(F.lit(' "<|x|>zoom  in":` ')).alias("t"), text.out_of_turns(F.lit("Max turns (40) exceeded"), 40).alias("a"), text.out_of_turns(F.lit("Max turns (40) exceeded"), 30).alias("b"), text.out_of_turns(F.lit("max turns exceeded"), 3).alias("c"), text.out_of_turns(F.lit("other"), 3).alias("d")).first()
    assert tuple(one) == ("zoom in", True, False, True, False)


def stained(side: int = 224) -> np.ndarray:
    """A tile of purple cells on pink ground."""
    y, x = np.mgrid[:side, :side]
    cell = ((x % 16 - 8) ** 2 + (y % 16 - 8) ** 2 < 25)[..., None]
    return np.where(cell, np.array([90, 50, 140]), np.array([200, 150, 190]))


def test_tissue_edges(spark):
    whole, right, wedge = stained(), stained(), stained()
    right[:, 140:] = 255
    y, x = np.mgrid[:224, :224]
    wedge[x + y < 94] = 255
    got = screening.metrics(np.stack([whole, right, wedge]))
    assert got["touches_tissue_edge"].tolist() == [0.0, 1.0, 1.0] and sorted(got) == sorted(screening.METRICS) and len(screening.METRICS) == 37
    rows = spark.createDataFrame([(0, 0, whole.ravel().tolist()), (0, 1, right.ravel().tolist()), (1, 2, wedge.ravel().tolist())], "slide int, id int, pixels array<int>").withColumn("side", F.lit(224))
    measured = rows.select("slide", "id", screening.tile_metrics("pixels", "side").alias("m"))
    kept = screening.select_tiles(measured.select("slide", "id", "m.*"), ["slide"], "id", ratio=1.0, least=1, trigger=1, reserve=0.0)
    assert [(r.slide, r.id) for r in kept.collect()] == [(0, 0)]
    assert 0 <= measured.select(screening.dark_score(F.col("m")).alias("s")).first().s <= 1


def test_dark_boxes():
    tissue = np.zeros((40, 40), bool)
    tissue[6:30, 7:29] = True
    x0, y0, x1, y1, _ = screening.trimmed((4, 4, 32, 32, 700), tissue)
    assert 6 <= y0 and y1 <= 30 and 7 <= x0 and x1 <= 29
    assert screening.joined([(0, 0, 4, 4, 16), (5, 0, 9, 4, 16), (30, 30, 32, 32, 4)], 2) == [(0, 0, 9, 4, 32), (30, 30, 32, 32, 4)]
    y, x = np.mgrid[:48, :48]
    assert screening.trimmed((0, 0, 28, 28, 700), x + y >= 18) is not None
    score, tissue = np.zeros((64, 64)), np.zeros((64, 64), bool)
    tissue[20:44, 20:45] = True
    score[tissue] = 0.10
    score[24:32, 24:32], score[24:32, 35:43] = 0.95, 0.60
    boxes, _ = screening.dark_regions(score, tissue, 90, 16)
    assert boxes[0][0] <= 24 and boxes[0][2] >= 43
    score, tissue = np.full((96, 96), 0.12), np.ones((96, 96), bool)
    score[40:48, 42:50] = 0.92
    boxes, mask = screening.dark_regions(score, tissue, 90, 16)
    assert boxes[0][2] - boxes[0][0] <= 14 and boxes[0][3] - boxes[0][1] <= 14 and mask.sum() <= 180
    assert screening.dark_regions(score, np.zeros((96, 96), bool)) [0] == []


def test_grid_of_a_view():
    view = np.full((140, 140, 3), 255)
    view[40:60, 40:60] = stained(32)[:20, :20]
    found = screening.grid_fallback(view, 3)
    assert len(found) == 1 and all(abs(v - 357) < 80 for v in found[0][1:])


def test_fresh_regions(spark):
    rows = spark.createDataFrame([(0, i, float(x), 0.0, i) for i, x in enumerate([0, 40, 60, 200])], "slide int, id int, cx double, cy double, rank int")
    assert [r.id for r in selection.fresh_regions(rows, ["slide"], 100).orderBy("id").collect()] == [0, 2, 3]
    box = spark.range(1).select(selection.box_of_view(F.lit(100), F.lit(100), F.lit(400), F.lit(200), (F.lit(0), F.lit(0), F.lit(999), F.lit(999)), F.lit(5000), F.lit(5000)).alias("b")).first().b
    assert (box.w, box.h) == (140, 100) and box.x == 180


def test_reduced_precision(spark):
    rows = spark.createDataFrame([(k, [1.2345678, -9.87654, 0.0]) for k in range(50)], "k long, v array<float>")
    got = [r.w for r in rows.select(vectors.reduced_precision(5)("k", "v").alias("w")).collect()]
    flat = np.array(got, np.float32)
    assert (np.abs(flat - np.float32([1.2345678, -9.87654, 0.0])) <= np.abs(np.float32([1.2345678, -9.87654, 0.0])) / 2**5).all() and len(np.unique(flat[:, 0])) > 5
    assert (flat.view(np.uint32) & ((1 << 0) - 1) == 0).all() and got == [r.w for r in rows.select(vectors.reduced_precision(5)("k", "v").alias("w")).collect()]
