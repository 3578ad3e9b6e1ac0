"""Fixtures for what SQL can't express, with hand-computed results."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilecohort.functions import image, tails, text
from tilecohort.operators import assembly, metrics, ranking, tiling, vectors
from tilecohort.sources import tables

# order, hint fixtures: scores, dark, bad likelihood, margin, bad top-1, good top-1, k, expected order
RANKED = {
    "by_quality": ([0.60, 0.45, 0.43], [0.82, 0.74, 0.72], [0.58, 0.35, 0.37], [-0.01, 0.10, 0.08], [0.45, 0.28, 0.30], [0.43, 0.56, 0.54], 3, [0, 1, 2]),
    "support": ([0.58, 0.50], [0.82, 0.76], [0.50, 0.30], [0.07, 0.11], [0.30, 0.26], [0.62, 0.57], 2, [0, 1]),
    "penalty": ([0.95, 0.75, 0.10], [0.22, 0.68, 0.20], [0.90, 0.20, 0.25], [-0.10, 0.14, 0.01], [0.80, 0.18, 0.30], [0.10, 0.64, 0.31], 2, [1, 2]),
    "floor_applies": ([0.95, 0.86, 0.80], [0.01, 0.24, 0.22], [0.18, 0.20, 0.22], [0.16, 0.14, 0.12], [0.10, 0.14, 0.16], [0.74, 0.68, 0.65], 2, {1, 2}),
    "floor_skipped": ([0.91, 0.86, 0.80], [0.01, 0.01, 0.03], [0.20, 0.22, 0.18], [0.12, 0.10, 0.16], [0.20, 0.22, 0.18], [0.66, 0.70, 0.72], 3, {0, 1, 2}),
}


@pytest.mark.parametrize("name", sorted(RANKED))
def test_combined_ranking(spark, name):
    score, dark, like, margin, bad, good, k, want = RANKED[name]
    rows = spark.createDataFrame([(0, i, *r) for i, r in enumerate(zip(score, dark, like, margin, bad, good))], "slide int, id int, retrieval double, dark double, bad_likelihood double, margin double, bad_top1 double, good_top1 double")
    kept = ranking.conditional_floor(rows, ["slide"], F.col("dark") >= ranking.DEFAULT.min_dark, k)
    got = [r.id for r in ranking.top_k(ranking.combined_score(kept, ["slide"]), ["slide"], k, F.desc("combined"), F.col("id")).orderBy("rank").collect()]
    assert (set(got) if isinstance(want, set) else got) == want


def test_hint(spark):
    rows = spark.createDataFrame([(0, 0.01, 0.39, 0.40, 0.42), (1, 0.12, 0.33, 0.26, 0.55), (2, 0.07, 0.50, 0.30, 0.62)], "id int, margin double, bad_likelihood double, bad_top1 double, good_top1 double")
    got = {r.id: r.h for r in rows.select("id", ranking.quality_hint().alias("h")).collect()}
    assert got == {0: "uncertain", 1: "good_like", 2: "good_like"}


def test_exact_neighbours(spark):
    tiles = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [-1.0, 0.0])], "id long, vector array<float>")
    refs = spark.createDataFrame([(0, [1.0, 0.0], True), (1, [0.0, 1.0], True), (2, [-1.0, 0.0], False)], "id long, vector array<float>, good boolean")
    near = {(r.id, r["rank"]): r.ref for r in vectors.nearest(tiles, refs.filter("good"), 2).collect()}
    assert [near[0, 1], near[0, 2]] == [0, 1] and [near[2, 1], near[2, 2]] == [1, 0]
    got = {r.id: r for r in vectors.reference_scores(tiles, refs, 2).collect()}
    assert [round(got[i].margin, 3) for i in range(4)] == [1.5, 1.546, 0.663, -1.5]
    assert [round(got[i].bad_likelihood, 3) for i in range(4)] == [0.011, 0.010, 0.120, 0.989]


def test_suppression_and_diversity(spark):
    rows = spark.createDataFrame([(0, i, float(x), 0.0, i + 1) for i, x in enumerate([0, 50, 120, 400, 410])], "slide int, id int, cx double, cy double, rank int")
    assert [r.id for r in ranking.suppress(rows, ["slide"], 100.0, 3).orderBy("rank").collect()] == [0, 2, 3]
    kept = ranking.diversify(rows, ["slide"], [(0.0, 0.0)], 100.0, 60.0, 3, 5).orderBy("rank").collect()
    assert [r.id for r in kept] == [2, 3, 4]  # the last one fills up
    attempted = spark.createDataFrame([(0, 0, -10, 20, 20)], "slide int, x int, y int, w int, h int")
    assert ranking.next_unattempted(rows, attempted, ["slide"], 100.0).first()["rank"] == 3
    wide = spark.createDataFrame([(0, -400, -400, 820, 820)], "slide int, x int, y int, w int, h int")  # half a side is 410
    assert ranking.next_unattempted(rows, wide, ["slide"], 100.0).collect() == []


def test_suppression_goes_through_the_whole_order(spark):
    """80 candidates close together come before 20 far apart: all ten places are filled."""
    rows = spark.createDataFrame([(s, i, float(i) if i < 80 else 1000.0 * i, 0.0, i + 1) for s in (0, 1) for i in range(100)], "slide int, id int, cx double, cy double, rank int")
    got = ranking.suppress(rows, ["slide"], 500.0, 10)
    assert {s: [r.id for r in got.filter(F.col("slide") == s).orderBy("rank").collect()] for s in (0, 1)} == {s: [0, *range(80, 89)] for s in (0, 1)}
    assert ranking.diversify(rows, ["slide"], [], 500.0, 0.0, 5, 10).count() == 20


def test_distribution_tails():
    assert tails.t_quantile(0.975, [1, 4, 10, 30]) == pytest.approx([12.7062, 2.7764, 2.2281, 2.0423], abs=1e-4)
    assert tails.t_two_sided([2.7764, 2.2281], [4, 10]) == pytest.approx([0.05, 0.05], abs=1e-5)
    assert tails.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)


def test_survival(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("a", 3, 1)], "g string, t int, e int")
    km = {r.t: r.survival for r in metrics.kaplan_meier(rows, ["g"], "t", "e").collect()}
    assert km == {1: 0.75, 2: 0.75, 3: 0.0}
    assert metrics.comparable_pairs(rows, ["g"], "t", "e").first().pairs == 3


@pytest.mark.parametrize("said,want", [
    ("Final decision: acute LEUKEMIA", "Acute leukemia"), ("most consistent with normal marrow", "Normal marrow"),
    ("acute leukemia? no, normal marrow", "Normal marrow"), ("", ""), (None, ""), ("nothing", ""),
])
def test_final_decision(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(text.final_decision(F.col("t")).alias("d")).first().d == want


def test_json_repair():
    assert text.repair_json('Here: {"a": [1, 2,],}') == '{"a": [1, 2]}'
    assert text.repair_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert text.repair_json('{"roi_assessment": "[{""i"": 1}]", "b": 2}') == '{"b": 2, "roi_assessment": [{"i": 1}]}'
    assert text.repair_json("none") is None and text.repair_json(None) is None
    assert text.repair_json('<|begin_of_box|>\x1b[1m[{"a": ""x"", "b": null}, 2.5]\x1b[0m') == '[{"a": "x", "b": null}, 2.5]'
    assert text.repair_json('{"a": "line\nend", "b": "q\\"q \\u00e9"') == '{"a": "line\\nend", "b": "q\\"q \\u00e9"}'
    assert text.repair_json('{"roi_assessment": "[{\\"i\\": 1}]"}') == '{"roi_assessment": "[{\\"i\\": 1}]"}' and text.repair_json('{"roi_assessment": "[{\\"i\\": 1}]",}') == '{"roi_assessment": [{"i": 1}]}'
    assert text.repair_json('{"a" 1}') is None


def test_status_words(spark):
    rows = spark.createDataFrame([("dead",), ("alive",), ("2",), ("0.0",), ("NA",), (None,)], "s string")
    assert [r.v for r in rows.select(assembly.survival_status(F.col("s")).alias("v")).collect()] == [1, 0, 1, 0, None, None]


def test_multiset_join(spark):
    a = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.2, 2)], "x double, pos int")
    b = spark.createDataFrame([(0.1000001, 5), (0.1, 6), (0.3, 7)], "x double, pos int")
    got = sorted(((r.left_pos, r.right_pos) for r in assembly.multiset_join(a, b, ["x"], "pos").collect()), key=repr)
    assert got == [(0, 5), (1, 6), (2, None), (None, 7)]


def test_unique_key(spark):
    assert assembly.unique_key(spark.createDataFrame([(1,), (2,)], "k int"), "k").count() == 2
    with pytest.raises(Exception, match="repeated k"):
        assembly.unique_key(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>PATIENT</t></si><si><t>p1</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>AGE</t></is></c></row><row/><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "t.xlsx").write_bytes(data.getvalue())
    got = tables.workbook_table(tables.read_workbooks(spark, str(tmp_path / "*.xlsx")), ["PATIENT", "none", "AGE"]).collect()
    assert [(r.PATIENT, r.none, r.AGE) for r in got] == [("p1", None, "7")] and tables.column_index("AB") == 27


def test_masks_and_boxes():
    mask = np.zeros((40, 40), bool)
    mask[6:30, 7:29] = True
    assert image.components(mask) == [(7, 6, 22, 24, 528)]
    assert image.entropy(np.array([[0, 255]])) == 1.0


def test_class_support(spark):
    row = spark.createDataFrame([([0.2, 0.7, 0.1],)], "s array<double>").select(*[F.round(tiling.class_support(F.col("s"), F.lit(i)), 6).alias(f"c{i}") for i in range(3)]).first()
    assert tuple(row) == (-0.5, 0.5, -0.6)


def test_bootstrap_brackets_the_area(spark):
    rows = spark.createDataFrame([("t", i, int(i % 3 == 0), float(i % 3 == 0) + i % 7 / 5) for i in range(600)], "target string, id long, truth int, score double")
    area = metrics.auroc(rows, ["target"]).first().auroc
    got = metrics.bootstrap_auroc(rows, ["target"], "id").first()
    assert got.samples == 1000 and got.low < area < got.high and abs(got.median - area) < 0.01


def test_grid_is_linear(spark):
    points = spark.createDataFrame([("c", 0.0, 0.0), ("c", 0.5, 1.0), ("c", 1.0, 1.0), ("d", 0.3, 0.7)], "g string, x double, y double")
    got = {(r.g, r.step): r.y for r in metrics.on_grid(points, ["g"], "x", "y", 5).collect()}
    assert [got["c", i] for i in range(5)] == [0.0, 0.5, 1.0, 1.0, 1.0] and [got["d", i] for i in range(5)] == [0.7] * 5


def test_logrank_splits_at_the_median_of_all_rows(spark, tmp_path):
    """Keys divisible by five hold the largest risks, so a median without them would lie lower."""
    from datetime import date, timedelta

    from tilecohort.plans import catalogue

    n = 40
    risk = [float(1000 + k if k % 5 == 0 else k * 7 % 41) for k in range(n)]
    event = [int(k % 3 != 0) for k in range(n)]
    rows = [(k, k % 4, "1", date(1995, 1, 1) + timedelta(days=k * 11 % 23), "F" if event[k] else "O", risk[k]) for k in range(n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    high = [r > sorted(risk)[(n - 1) // 2] for r in risk]
    times = [k * 11 % 23 for k in range(n)]
    o = v = 0.0
    for t in set(times):
        y, y1 = sum(x >= t for x in times), sum(x >= t and h for x, h in zip(times, high))
        d, d1 = sum(x == t and e for x, e in zip(times, event)), sum(x == t and e and h for x, e, h in zip(times, event, high))
        o += d1 - d * y1 / y
        v += d * y1 / y * (1 - y1 / y) * (y - d) / (y - 1) if y > 1 else 0
    assert abs(catalogue.QUERIES["logrank_statistic"](spark, str(tmp_path)).first().chi2 - o * o / v) < 1e-5
