"""A table whose writes are published at once: segments of Parquet files, and a log whose last entry names those that count.

A writer puts its rows into a folder of their own first. Then it publishes by one rename of a
log entry to the next number, which the file system refuses if another writer took that number; the
writer then looks again at what holds now. So a reader sees one version whole, a write that fails leaves the old one,
and one that is run again after a failure leaves unread files at most. Needs a file system whose rename doesn't replace, as HDFS's.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published first."""


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, the first one 1."""
    _, place, fs = _hadoop(spark, f"{path}/_log")
    if not fs.exists(place):
        return []
    return sorted(int(name) for s in fs.listStatus(place) if (name := s.getPath().getName()).isdigit())


def _entry(spark: SparkSession, path: str, version: int) -> dict:
    jvm, place, fs = _hadoop(spark, f"{path}/_log/{version:020d}")
    stream = fs.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: int, segments: list[str], schema: str) -> None:
    """Publishes a version; raises Conflict if there is one of that number."""
    jvm, draft, fs = _hadoop(spark, f"{path}/_log/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"segments": segments, "schema": schema}).encode()))
    out.close()
    goal = jvm.org.apache.hadoop.fs.Path(f"{path}/_log/{version:020d}")
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    keep = spark.sparkContext._gateway.new_array(rename, 1)
    keep[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, goal, keep)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(f"version {version} of {path} is there") from None
        raise


def _segment(table: DataFrame, path: str) -> str:
    name = f"segment-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{name}")
    return name


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default; what is published later doesn't change them."""
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise ValueError(f"no version {version or ''} of {path}")
    entry = _entry(spark, path, version or there[-1])
    if not entry["segments"]:
        return spark.createDataFrame([], entry["schema"])
    return spark.read.schema(entry["schema"]).parquet(*[f"{path}/{s}" for s in entry["segments"]])


def _schema(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def publish(table: DataFrame, path: str, tries: int = 10) -> int:
    """Replaces what a path holds by the table's rows; returns the version. Of writers at once each gets a version of its own."""
    spark, own = table.sparkSession, _segment(table, path)
    for _ in range(tries):
        version = (versions(spark, path) or [0])[-1] + 1
        try:
            commit(spark, path, version, [own], _schema(table))
            return version
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} other writers came first")


def append_new(table: DataFrame, path: str, key: list[str], tries: int = 10) -> int:
    """Adds the rows whose key (null equals null) the last version lacks, one of each key; returns the version that holds them.

    If another writer publishes meanwhile, the rows are held against its version and written anew. A repeated append publishes nothing.
    """
    spark, rows = table.sparkSession, table.dropDuplicates(key)
    for _ in range(tries):
        last = (versions(spark, path) or [0])[-1]
        segments, new = [], rows
        if last:
            segments = _entry(spark, path, last)["segments"]
            old = read(spark, path, last).select(*[f"`{k}`" for k in key]).toDF(*[f"_old_{i}" for i in range(len(key))])
            same = [rows[k].eqNullSafe(old[f"_old_{i}"]) for i, k in enumerate(key)]
            new = rows.join(old, same, "left_anti")
        own = _segment(new, path)
        if last and spark.read.schema(_schema(table)).parquet(f"{path}/{own}").isEmpty():
            return last
        try:
            commit(spark, path, last + 1, [*segments, own], _schema(table))
            return last + 1
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} other writers came first")
