"""Readers and writers: text tables, workbooks, JSON documents, directory trees, tile archives, manifests."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Header words that mean a slide or a patient.
SLIDE_WORDS = ["filename", "slide", "slide_id", "slide_name"]
PATIENT_WORDS = ["patient", "patient_id", "case_id"]


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with every column a string; the header names the columns, a byte-order mark is dropped."""
    table = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return table.toDF(*[c.lstrip("﻿") for c in table.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings by its suffix: CSV, or the first sheet of a workbook, whose first row is the header; other suffixes raise."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_strings(spark, path)
    if kind != "xlsx":
        raise ValueError(f"no table reader for .{kind}")
    cells = read_workbooks(spark, path)
    header = cells.filter("row = 0").select("cells").first()  # one row
    return workbook_table(cells, [h or f"column_{i}" for i, h in enumerate(header[0])]).drop("path") if header else spark.createDataFrame([], "path string").drop("path")


def read_strings_or_none(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The CSV table at a path, or an empty one with the given columns if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
        return read_strings(spark, path)
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def first_found(places: list[DataFrame], key: list[str]) -> DataFrame:
    """Documents of several places, of each key from the first place that has it."""
    found = places[0]
    for place in places[1:]:
        found = found.unionByName(place.join(found.select(*key), key, "left_anti"))
    return found


def first_seen(table: DataFrame, column: str, order: str) -> DataFrame:
    """(value, first): the distinct values of a column as strings, blanks trimmed, with the place where each is first seen."""
    value = F.trim(F.col(column).cast("string"))
    return table.filter(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.min(order).alias("first"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files, lines counted from 1; a large file is read in splits.

    Each split numbers its own lines; the splits' line counts, a row a split, are summed up in order of their place in the file.
    """
    read = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = read.withColumn("i", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["path", "block"]).select("path", (F.col("i") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def read_coordinates(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """(x, y, keep) of CSV files with a header x0,y0 or x,y; a fraction is cut off.

    A row without two numbers fails the query with its file and line. Records are lines; empty lines are skipped. All files of a path need one header.
    """
    lines = numbered_lines(spark, path).withColumn("text", F.regexp_replace("text", "^\ufeff", ""))
    headers = [r.text for r in lines.filter("line = 1").select("text").distinct().take(2)]
    if len(headers) != 1:
        raise ValueError(f"{path}: {'several headers' if headers else 'no header'}")
    names = next(csv.reader(headers))
    low = {c.strip().lower(): i for i, c in enumerate(names)}
    pair = next(((low[a], low[b]) for a, b in (("x0", "y0"), ("x", "y")) if a in low and b in low), None)
    if pair is None:
        raise ValueError(f"{path}: no columns x0,y0 or x,y in {', '.join(names)}")
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = lines.filter("line > 1 AND trim(text) <> ''").withColumn("r", F.from_csv("text", fields, {"escape": '"'}))
    numbers = []
    for i, to in zip(pair, ("x", "y")):
        value = F.trim(F.col(f"r.c{i}")).try_cast("double")
        wrong = F.raise_error(F.concat(F.lit("bad coordinates in "), F.element_at(F.split("path", "/"), -1), F.lit(", line "), F.col("line").cast("string"), F.lit(": "), F.col("text"))).cast("long")
        numbers.append(F.when(value.isNull() | F.isnan(value) | (F.abs(value) > 9e18), wrong).otherwise(value.cast("long")).alias(to))
    return rows.select(*numbers, *[F.col(f"r.c{names.index(k)}").alias(k) for k in keep or []])


def resolve_regions(files: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """(folder, kind, path): what each folder's regions are read from: a manifest, else any JSON, else an images folder, else single images.

    A folder with an images folder gives its images in order of name; without any of these it has no row.
    """
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    image = name.rlike(r"\.(png|jpe?g|tiff?|bmp|webp)$")
    kind = F.when(name == "roi_collection.json", 0).when(name.endswith(".json"), 1).when(image & F.lower(path).contains("/images/"), 2).when(image, 3)
    ranked = files.withColumn("_k", kind).filter("_k IS NOT NULL")
    best = ranked.groupBy(folder).agg(F.min("_k").alias("_b"))
    held = ranked.join(best, folder).filter("_k = _b")
    first = held.filter("_k < 2").groupBy(folder, "_k").agg(F.min(path).alias(path))
    words = F.element_at(F.array(*map(F.lit, ("manifest", "json", "images", "image"))), F.col("_k") + 1)
    return first.select(folder, "_k", path).unionByName(held.filter("_k >= 2").select(folder, "_k", path)).select(folder, words.alias("kind"), path)


def column_index(letters: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    if value is None or value.text is None:
        return None
    return shared[int(value.text)] if kind == "s" else value.text


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of a workbook's first sheet that hold anything, absent cells null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        first = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))[0]
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_SHEET}row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(f"{_SHEET}c")):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                cells[column_index(letters[0]) if letters else i] = _cell(c, shared)
            if any(v not in (None, "") for v in cells.values()):
                yield [cells.get(i) for i in range(max(cells) + 1)]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of the first sheet of every workbook; row 0 is the header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = list(sheet_rows(content))
                yield pd.DataFrame({"path": file, "row": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def workbook_table(cells: DataFrame, header: list[str]) -> DataFrame:
    """Cells as a table of strings under a header."""
    return cells.filter("row > 0").select("path", *[F.try_element_at("cells", F.lit(i + 1)).alias(h) for i, h in enumerate(header)])


def resolve_column(columns: list[str], words: list[str]) -> str | None:
    """The column whose name is one of the words, whatever its case; the first word wins."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    return next((low[w] for w in words if w in low), None)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with the file's path."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def with_path_keys(table: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from groups of a pattern over each row's file path."""
    path = F.col("_metadata.file_path")
    return table.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def distinct_first_column(table: DataFrame) -> DataFrame:
    """The set of values of the first column, quotes and blanks trimmed, empty ones left out."""
    value = F.trim(F.regexp_replace(F.col(table.columns[0]), "[\"']", ""))
    return table.select(value.alias("value")).filter("value <> ''").distinct()


def microns_per_pixel(properties: Column, comment: Column, xml: Column, default: float | None = None) -> Column:
    """(mpp, source): a property, else a comment, else an XML attribute, else ten over the objective's power, else the default."""
    options = [
        ("property", F.coalesce(*[F.try_element_at(properties, F.lit(k)).try_cast("double") for k in ("openslide.mpp-x", "openslide.mpp-y", "aperio.MPP")])),
        ("comment", F.regexp_extract(comment, r"(?i)mpp\s*[=:]\s*([0-9.]+)", 1).try_cast("double")),
        ("xml", F.regexp_extract(xml, r'PhysicalSizeX="([0-9.]+)"', 1).try_cast("double")),
        ("power", F.try_divide(F.lit(10.0), F.try_element_at(properties, F.lit("openslide.objective-power")).try_cast("double"))),
        ("default", F.lit(default).cast("double")),
    ]
    return F.coalesce(*[F.when(v > 0, F.struct(v.alias("mpp"), F.lit(n).alias("source"))) for n, v in options])


#: Bytes of an archive that one task reads.
ARCHIVE_SHARE = 64 << 20


def _opened(path: str) -> fs.NativeFile:
    """A file as Spark names it, open for reading at any place."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _entry(file: fs.NativeFile, name: str, start: int, stored: int, method: int, crc: int) -> bytes:
    """The content of the entry whose header starts at ``start``."""
    file.seek(start)
    header = file.read(30)
    file.seek(start + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little"))
    data = file.read(stored)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -zlib.MAX_WBITS)
    if zlib.crc32(data) != crc:
        raise ValueError(f"damaged archive entry: {name}")
    return data


def archive_entries(spark: SparkSession, path: str, pattern: str = r"\(?(-?[0-9.]+),\s*(-?[0-9.]+)\)?", share_bytes: int = ARCHIVE_SHARE) -> DataFrame:
    """(path, entry, x_um, y_um, image) of every tile of zipped tile caches; coordinates come from entry names, others are skipped.

    First only the directories of the archives are read; then the entries are dealt out by ranges of ``share_bytes``, so
    many tasks read one archive. Repeated names give a row each. Entries that are encrypted, damaged or neither stored nor deflated raise.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                # a small archive is read whole: zipfile looks for records before its beginning
                with _opened(file) as f, zipfile.ZipFile(f if f.size() > 65_536 else io.BytesIO(f.read())) as z:
                    found = [(i, at) for i in z.infolist() if (at := re.search(pattern, i.filename))]
                for i, _ in found:
                    if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"archive entry of an unknown form: {file}, {i.filename}")
                columns = {"entry": "filename", "start": "header_offset", "stored": "compress_size", "method": "compress_type", "crc": "CRC"}
                rows = {c: [getattr(i, of) for i, _ in found] for c, of in columns.items()}
                if found:
                    yield pd.DataFrame({"path": [file] * len(found), "x_um": [float(a[1]) for _, a in found], "y_um": [float(a[2].rstrip(".")) for _, a in found]} | rows)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, rows in batch.groupby("path", sort=False):
                with _opened(file) as f:
                    for i in range(0, len(rows), 256):
                        some = rows.iloc[i : i + 256].to_dict("list")
                        images = [_entry(f, *r) for r in zip(*(some[c] for c in ("entry", "start", "stored", "method", "crc")))]
                        yield pd.DataFrame({c: some[c] for c in ("path", "entry", "x_um", "y_um")} | {"image": images})

    files = spark.read.format("binaryFile").load(path).select("path")
    entries = files.mapInPandas(listed, "path string, x_um double, y_um double, entry string, start long, stored long, method int, crc long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(tasks, "path", F.floor(F.col("start") / share_bytes)).sortWithinPartitions("path", "start")
    return dealt.mapInPandas(read, "path string, entry string, x_um double, y_um double, image binary")


def labelled_tiles(files: DataFrame, root_labels: dict[str, str]) -> DataFrame:
    """(path, label) of image files under class folders; of a repeated path the first label by name stays."""
    label = F.coalesce(*[F.when(F.col("path").contains(f"/{folder}/"), F.lit(name)) for folder, name in root_labels.items()])
    images = files.filter(F.lower("path").rlike(r"\.(png|jpe?g|tiff?|bmp|webp)$")).select("path", label.alias("label")).filter("label IS NOT NULL")
    return images.groupBy("path").agg(F.min("label").alias("label"))


def ordered_union(tables: list[DataFrame], preferred: list[str]) -> DataFrame:
    """All rows, preferred columns first, then others as first seen; absent values are empty strings."""
    seen = list(dict.fromkeys([*preferred, *(c for t in tables for c in t.columns)]))
    return _union([t.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in t.columns else F.lit("").alias(c) for c in seen]) for t in tables])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def write_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header; the committer publishes them together."""
    table.write.mode(mode).csv(path, header=True)


def public_json(row: Column, fields: list[str]) -> Column:
    """A document of the fields whose names don't begin with an underscore."""
    return F.to_json(F.struct(*[row[f].alias(f) for f in fields if not f.startswith("_")]), {"ignoreNullFields": "false"})
