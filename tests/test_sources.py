"""Published versions, numbered lines of split files, and members stripped from documents."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilecohort.functions import documents
from tilecohort.sources import tables, versions



def test_versions_stay_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path)
    assert versions.append_new(rows, path, ["k"]) == 1 and versions.append_new(rows, path, ["k"]) == 1
    first = versions.read(spark, path)
    assert versions.append_new(rows.unionByName(spark.createDataFrame([(3, "d")], "k int, v string")), path, ["k"]) == 2
    assert {r.k for r in first.collect()} == {1, 2, None} and {r.k for r in versions.read(spark, path).collect()} == {1, 2, 3, None}
    # a write that fails before it is published leaves the version before
    with pytest.raises(Exception, match="broken"):
        versions.publish(rows.withColumn("v", F.raise_error(F.lit("broken")).cast("string")), path)
    assert versions.versions(spark, path) == [1, 2] and versions.read(spark, path).count() == 4
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 2, [], "k int")
    # another writer comes first: the append is held against its version
    publish, done = versions.commit, []

    def overtaken(session, place, version, segments, schema):
        if not done:
            done.append(1)
            other = versions._segment(spark.createDataFrame([(7, "x"), (8, "y")], "k int, v string"), path)
            publish(session, place, version, [*versions._entry(session, place, 2)["segments"], other], schema)
        publish(session, place, version, segments, schema)

    monkeypatch.setattr(versions, "commit", overtaken)
    assert versions.append_new(spark.createDataFrame([(8, "late"), (9, "z")], "k int, v string"), path, ["k"]) == 4
    assert {(r.k, r.v) for r in versions.read(spark, path).filter("k > 6").collect()} == {(7, "x"), (8, "y"), (9, "z")}
    assert versions.read(spark, path, 1).count() == 3


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a.csv", 5000), ("b.csv", 3)):
        (tmp_path / name).write_text("﻿X0,y0,note\r\n" + "".join(f"{i},{i / 2},n{i}\r\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = tables.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = {(r.path.rsplit("/", 1)[-1], r.line): r.text for r in lines.filter("line > 1").collect()}
        assert got == {(name, i + 2): f"{i},{i / 2},n{i}" for name, n in (("a.csv", 5000), ("b.csv", 3)) for i in range(n)}
        assert {(r.x, r.y, r.note) for r in tables.read_coordinates(spark, str(tmp_path), keep=["note"]).collect()} == {(i, i // 2, f"n{i}") for i in range(5000)}
        (tmp_path / "c.csv").write_text("X0,y0,note\n" + "1,2,n\n\n" * 2000 + "3,west,n\n" + "1,2,n\n" * 2000)
        with pytest.raises(Exception, match="bad coordinates in c.csv, line 4002: 3,west,n"):
            tables.read_coordinates(spark, str(tmp_path / "c.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _walk(value, names):
    if isinstance(value, dict):
        return {k: _walk(v, names) for k, v in value.items() if k not in names}
    return [_walk(v, names) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("indent", [None, 1])
def test_members_go_at_any_depth(indent):
    names = frozenset(documents.PATHS)
    cases = [
        {}, [], 1, "path", {"path": {"x": "/s"}}, {"path": ["/p"], "a": 1}, {"a": 1, "path": [{"b": "}"}]}, {"a": "path", "b": ["path", {"path": 1, "c": {"out_dir": None}}]},
        {"path": 1, "debug_path": 2}, {"path": 1, "a": {"path": 2}, "debug_path": {"q": [1, {"path": 3}]}, "z": 'say "path": 1, {'}, [[{"path": []}], {"paths": 1, "x": {"y": {"overview_path": True, "w": -1.5e3}}}],
    ]
    for case in cases:
        text = json.dumps(case, indent=indent)
        assert json.loads(documents.stripped(text, names)) == _walk(case, names), text
        if json.dumps(_walk(case, names)) == json.dumps(case):
            assert documents.stripped(text, names) == text


def test_strip_keeps_nulls_and_what_is_no_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("no json",), ('{"path": 1',), ('"open',)], "t string")
    assert [r.c for r in df.select(documents.without_paths("t").alias("c")).collect()] == [None, "", "no json", "{", '"open']


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    tiles = {f"tile_({i}.5, {-i})_{i}.png": rng.bytes(2000) + bytes(500) for i in range(100)}
    for name, method in (("slide one.zip", zipfile.ZIP_DEFLATED), ("b.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            z.writestr("about.txt", "no tile")
            for entry, content in tiles.items():
                z.writestr(entry, content)
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    found = tables.archive_entries(spark, str(tmp_path / "*.zip"), share_bytes=20_000)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.entry, r.x_um, r.y_um, bytes(r.image)) for r in rows) == sorted((a, e, float(e[6:].split(",")[0]), -float(e[6:].split(".")[0]), c) for a in ("slide one.zip", "b.zip") for e, c in tiles.items())
    assert all(len({r.task for r in rows if r.path.endswith(a)}) > 1 for a in ("one.zip", "b.zip"))


def test_a_damaged_archive_entry_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("(1,2)", b"x" * 100)
    content = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(content.replace(b"x" * 100, b"x" * 99 + b"y"))
    with pytest.raises(Exception, match="damaged archive entry"):
        tables.archive_entries(spark, str(tmp_path / "a.zip")).collect()
