"""Tables that Spark takes for smaller than they are, and inputs with nulls, repeats and fractions."""

import random

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilecohort.llm import simhash
from tilecohort.operators import index, selection, tiling, vectors
from tilecohort.plans import catalogue, cohort, indexed  # noqa: F401


@pytest.fixture()
def parts(spark, tmp_path):
    rows = [(1, 20), (1, 3), (2, 50), (3, 0), (4, None), (None, 9), (None, 12)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def joined_by_broadcast(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["supertile_keep_counts", "supertile_priority"])
def test_cells_are_not_broadcast(spark, parts, name):
    assert not joined_by_broadcast(catalogue.QUERIES[name](spark, parts))


def test_cells_of_repeated_and_null_slides(spark, parts):
    cells = cohort._cells(spark, parts)
    counted = {r.slide: r.n for r in cells.groupBy("slide").agg(F.count("*").alias("n")).collect()}
    assert {(r.slide, r.n) for r in cells.select("slide", "n").distinct().collect()} == set(counted.items())
    assert counted == {1: 4 * 3 + 1, 2: 10 * 7, None: 2 * 2 + 3 * 2}
    assert {(r.slide, r.keep) for r in cells.select("slide", "keep").distinct().collect()} == {(1, 4), (2, 16), (None, 4)}


def test_cell_count_is_that_of_the_grid(spark):
    slides = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate([(512, 512), (513, 1), (1, 1024), (0, 9), (-5, -5), (None, 7), (1500, 1025)])], "slide long, width int, height int")
    made = tiling.supertiles(slides, "width", "height", 512).groupBy("slide").agg(F.count("*").alias("n"))
    said = slides.select("slide", tiling.cell_count(F.col("width"), F.col("height"), 512).alias("n")).filter("n > 0")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, said.collect()))


def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 300)
    fps = np.unique(np.concatenate([fps, fps[:100] ^ 0b11, fps[:50] ^ (1 << 40)]))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps)], "doc long, fp long")
    plans = {}

    def spy(f):
        def run(df, *label):
            plans[label or f"components {len(plans)}"] = joined_by_broadcast(df)
            return f(df, *label)

        return run

    monkeypatch.setattr(simhash, "written", spy(simhash.written))
    monkeypatch.setattr(simhash, "connected", spy(simhash.connected))
    got = {(r.node, r.component) for r in simhash.linked(nodes).collect()}
    assert not plans[("minor",)] and not [v for k, v in plans.items() if str(k).startswith("components ")][-1]
    first = list(range(len(fps)))
    for i, x in enumerate(fps.tolist()):
        for j in range(i):
            if (x ^ int(fps[j])).bit_count() <= simhash.BITS:
                low, high = sorted((first[i], first[j]))
                first = [low if c == high else c for c in first]
    assert got == {(i, c) for i, c in enumerate(first) if first.count(c) > 1} and got


@pytest.fixture()
def listed(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x[:60] = x[0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    index.build(rows, str(tmp_path / "index"))
    return rows, str(tmp_path / "index"), x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("probes", [1000, 7])
@pytest.mark.parametrize("edge", [4096, 30])
def test_search_in_blocks(spark, monkeypatch, listed, probes, edge):
    """Long and short lists, many equal vectors, small slices: as by brute force; only the table of lists is broadcast."""
    monkeypatch.setattr(index, "BLOCK", edge)
    rows, path, x = listed
    got = index.search(rows, path, 5, probes, skip_self=True)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1
    _, centres = index.opened(spark, path)
    own = np.zeros(400, int)
    for r in index.vectors_of(spark, path).collect():
        own[r.id] = r.list
    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
    want = set()
    for i in range(400):
        refs = [j for j in range(400) if j != i and own[j] in near[i]]
        want |= {(i, j, n + 1) for n, j in enumerate(sorted(refs, key=lambda j: (-round(float(x[i] @ x[j]), 12), j))[:5])}
    assert {(r.id, r.ref, r["rank"]) for r in got.collect()} == want


def test_queries_move_once_a_block(spark, listed):
    rows, path, _ = listed
    _, centres = index.opened(spark, path)
    sizes = np.array([5, 30, 2, 2, 70, 1] + [0] * (len(centres) - 6))
    first, pieces = index.blocks(sizes, 31)
    assert list(zip(first, pieces))[:6] == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (6, 1)]
    asked = index._unit(rows, "id", "vector")
    assert index._sent(asked, centres, len(centres), *index.blocks(sizes, 1000)).count() == 400
    sent = index._sent(asked, centres, len(centres), first, pieces)
    assert sent.count() == sent.select("id", "b").distinct().count() == 400 * 7


def test_best_of_a_block_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (50, 3)).astype(float)
    x[7] = np.nan
    ids = rng.permutation(50) * 3
    unit = vectors._matrix(pa.array(x.tolist()))
    want = []
    for i in range(50):
        refs = [j for j in range(50) if ids[j] != ids[i] and np.isfinite(unit[i] @ unit[j])]
        want += [(ids[i], ids[j], round(float(unit[i] @ unit[j]), 12)) for j in sorted(refs, key=lambda j: (-round(float(unit[i] @ unit[j]), 12), ids[j]))[:4]]
    for size in (1, 120, 1 << 21):
        monkeypatch.setattr(vectors, "SLICE", size)
        got = vectors._best(ids, ids, unit, pa.array(x.tolist()), 4, True).to_pydict()
        assert list(zip(got["id"], got["ref"], got["sim"])) == want
    assert vectors._best(ids, ids[:0], unit[:0], pa.array(x.tolist()), 4, True).num_rows == 0


def test_recall_broadcasts_tables_of_lists_alone(spark):
    got = catalogue.QUERIES["index_recall"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 2
    assert [tuple(r) for r in got.collect()] == [(500, True)]


def test_cells_to_be_separated_are_not_broadcast(spark, parts, monkeypatch):
    plans = []

    def spy(rows, *args, f=selection.independent, **more):
        plans.append(joined_by_broadcast(rows))
        return f(rows, *args, **more)

    monkeypatch.setattr(selection, "independent", spy)
    got = catalogue.QUERIES["supertile_selection"](spark, parts)
    assert plans == [False]
    assert {(r.slide, r["count"]) for r in got.groupBy("slide").count().collect()} == {(1, 4), (2, 16), (None, 4)}


def test_overlap_of_odd_boxes_equals_sql(spark, tmp_path):
    """Fractions of a pixel, places and sizes that are null or not positive, slides that are null or repeat."""
    draw = random.Random(5)
    parts = [(k, draw.choice([1, 7, 20, 50])) for k in [*range(30), 3, 4, None]] + [(40, None), (41, 0)]
    odd = lambda v, p=0.15: None if draw.random() < p else v
    lines = [
        (odd(draw.randrange(-4000, 90000)), odd(draw.randrange(34)), odd(draw.randrange(-1, 8)), odd(draw.choice([draw.uniform(-2, 50), draw.randrange(400) / 40, draw.randrange(50) + 0.0])), odd(draw.choice("RRRN")))
        for _ in range(600)
    ]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    name = "box_overlap_fraction"
    assert oracle.differences(spark, oracle.connect(str(tmp_path)), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path)) == ""


def test_huge_boxes_meet_the_cells_of_their_slide_alone(spark):
    cells = spark.createDataFrame([(1, x, 0) for x in (0, 10, 20)], "slide long, x0 int, y0 int")
    boxes = spark.createDataFrame([(1, 15, -(1 << 30), 1 << 30, (1 << 30) + 5), (2, 0, 0, 9, 9)], "slide long, x int, y int, w int, h int")
    got = {(r.x0, r.overlap) for r in tiling.overlap_fraction(cells, boxes, "slide", ["x0", "y0"], 10).collect()}
    assert got == {(0, 0.0), (10, 0.25), (20, 0.5)}
    none = boxes.filter("slide = 2")
    for covered in (False, True):
        assert {r.overlap for r in tiling.overlap_fraction(cells, none, "slide", ["x0", "y0"], 10, bare_covered=covered).collect()} == {float(covered)}
