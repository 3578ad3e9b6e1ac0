"""Clinical tables: survival rows, feature attributes, joins that keep what is unlabelled, overlays, experiment matrices, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assembly import null_tokens, survival_status
from .ordered import ranged, running, with_group

#: Words of a status that isn't known yet, once trimmed and lower-cased.
TILE = "tile"


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows, if the header has all names; nothing is scanned."""
    absent = [n for n in names if n not in rows.columns]
    if absent:
        raise ValueError(f"columns missing: {', '.join(absent)}")
    return rows


def survival_rows(rows: DataFrame, patient: str, time: str, status: str) -> DataFrame:
    """(patient, time, event) of string columns: rows without a time are left out; the status may be null, unknown words raise.

    Of rows that repeat a patient, all stay: ``assembly.first_of`` chooses.
    """
    held = rows.select(patient, null_tokens(F.col(time)).alias("_t"), F.col(status).alias("_s")).filter("_t IS NOT NULL")
    return held.select(patient, F.col("_t").cast("double").alias("time"), survival_status(F.col("_s")).alias("event"))


def coordinate_attributes(attributes: dict[str, Column], stride: Column) -> Column:
    """(dialect, tile_size_um, tile_size_px, scale): how a feature file's coordinates become micrometres.

    A tile size with unit um, else one in micrometres, else a tile size or, without one, a stride of about 224
    pixels of the old 256 um tiles; files that fit none raise.
    """
    size, unit, um, px = (attributes[k] for k in ("tile_size", "unit", "tile_size_um", "tile_size_px"))
    real = lambda c: c.isNotNull() & (c != 0)
    made = lambda name, s, p, k: F.struct(F.lit(name).alias("dialect"), s.cast("double").alias("tile_size_um"), p.cast("int").alias("tile_size_px"), k.alias("scale"))
    one = F.lit(1.0)
    unknown = F.raise_error(F.lit("coordinates can't be inferred")).cast("struct<dialect:string,tile_size_um:double,tile_size_px:int,scale:double>")
    return (
        F.when(real(size) & (unit == "um"), made("unit", size, px, one))
        .when(real(um), made("micrometres", um, px, one))
        .when(F.bround(F.coalesce(size, stride)) == 224, made("historic", F.lit(256.0), F.lit(224), F.lit(256.0 / 224)))
        .otherwise(unknown)
    )


def min_stride(tiles: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """The least step between distinct coordinates of a group, over both axes; null where neither axis has two."""
    axes = [tiles.select(*by, F.lit(n).alias("axis"), F.col(c).cast("double").alias("v")).distinct() for n, c in (("x", x), ("y", y))]
    both = axes[0].unionByName(axes[1])
    step = F.col("v") - F.lag("v").over(Window.partitionBy(*by, "axis").orderBy("v"))  # distinct coordinates of one slide's axis
    return both.withColumn("step", step).groupBy(*by).agg(F.min("step").alias("stride"))


def feature_type(files: DataFrame, by: list[str], kind: str = "feat_type", encoder: str = "encoder") -> DataFrame:
    """The one feature type of a group's files; files with neither type nor encoder hold tiles, mixed types raise."""
    of = F.when(F.col(kind).isNull() & F.col(encoder).isNull(), F.lit(TILE)).otherwise(F.coalesce(F.col(kind), F.lit("None")))
    s = files.groupBy(*by).agg(F.array_sort(F.collect_set(of)).alias("kinds"))  # a few words a group
    mixed = F.raise_error(F.concat(F.lit("mixed feature types: "), F.array_join("kinds", ", "))).cast("string")
    return s.select(*by, F.when(F.size("kinds") > 1, mixed).otherwise(F.element_at("kinds", 1)).alias("feat_type"))


def with_unlabelled(patients: DataFrame, slides: DataFrame, features: DataFrame, patient: str, slide: str) -> DataFrame:
    """Every patient who has slides with features, with those slides in order; labels are null for patients the table lacks."""
    held = slides.join(features.select(slide).distinct(), slide, "left_semi").groupBy(patient).agg(F.array_sort(F.collect_set(slide)).alias("slides"))
    return patients.join(held, patient, "right")


def patient_level(labels: DataFrame, files: DataFrame, patient: str, path: str, suffix: str = ".h5") -> DataFrame:
    """Labelled patients whose own feature file, named after them, is there; ``missing`` of ``assembly`` reports the others."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    held = files.filter(F.endswith(name, F.lit(suffix))).select(F.left(name, F.length(name) - len(suffix)).alias(patient), F.col(path).alias("feature_file"))
    return labels.join(held.dropDuplicates([patient]), patient)


def overlay(runs: DataFrame, live: DataFrame, saved: DataFrame, run: str, value: str, status: str = "status") -> DataFrame:
    """Each run's live value, else, once it is done, the saved one; else null."""
    a, b = live.select(run, F.col(value).alias("_live")), saved.select(run, F.col(value).alias("_saved"))
    joined = runs.join(a, run, "left").join(b, run, "left")
    has = F.col("_live").isNotNull() & (F.size("_live") > 0)
    return joined.select(*[runs[c] for c in runs.columns], F.when(has, F.col("_live")).when(F.col(status) == "done", F.col("_saved")).otherwise(F.col("_live")).alias(value))


def experiment_matrix(models: DataFrame, extractors: DataFrame, wanted_models: list[str], wanted_extractors: list[str], order: str) -> DataFrame:
    """(model, extractor) of all wanted pairs, distinct, numbered as first seen; an empty list wants all.

    Both tables are configuration: a row a choice.
    """
    pick = lambda rows, c, wanted: (rows.filter(F.col(c).isin(wanted)) if wanted else rows).groupBy(c).agg(F.min(order).alias(f"_{c}"))
    pairs = pick(models, "model", wanted_models).crossJoin(F.broadcast(pick(extractors, "extractor", wanted_extractors)))
    return pairs.select("model", "extractor", F.row_number().over(Window.orderBy("_model", "_extractor")).alias("number"))


def declared_classes(rows: DataFrame, target: str, outputs: int) -> DataFrame:
    """rows, which fail unless the target has exactly ``outputs`` classes."""
    n = rows.agg(F.count_distinct(target).alias("_n"))
    wrong = F.raise_error(F.format_string(f"{target} has %d classes, {outputs} outputs", F.col("_n"))).cast("boolean")
    return rows.crossJoin(F.broadcast(n.select(F.when(F.col("_n") != outputs, wrong).otherwise(True).alias("_ok")))).filter("_ok").drop("_ok")


def hashed_order(key: Column | str, seed: int = 0) -> Column:
    """A fixed shuffle: rows in the order of the md5 of seed and key, which any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")).cast("binary"))


def seeded_sample(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of each group, by hash; groups with fewer are left out."""
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_all", F.count("*").over(w)).filter(F.col("_all") >= n).withColumn("_r", F.row_number().over(w.orderBy(hashed_order(F.col(key), seed), key)))
    return placed.filter(F.col("_r") <= n).drop("_all", "_r")


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float = 0.25, seed: int = 0) -> DataFrame:
    """rows with ``part``: the first ceil(share * n) of each stratum by hash are valid, the others train."""
    order = [F.col("_h"), F.col(key)]
    placed = running(ranged(rows.withColumn("_h", hashed_order(F.col(key), seed)), [stratum], *order), [stratum], order, _i=F.lit(1))
    n = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    return with_group(placed, n, [stratum]).select(*rows.columns, F.when(F.col("_i") <= F.ceil(F.col("_n") * share), "valid").otherwise("train").alias("part"))


def virtual_slide(tiles: DataFrame, patient: str, slide: str, x: str, size: str) -> DataFrame:
    """Tiles with x moved right by the widths of the patient's slides before theirs; a slide is as wide as its last tile's right edge."""
    widths = tiles.groupBy(patient, slide).agg(F.max(F.col(x) + F.col(size)).alias("_w"))
    before = Window.partitionBy(patient).orderBy(slide).rowsBetween(Window.unboundedPreceding, -1)  # a row a slide
    offsets = widths.select(patient, slide, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    return tiles.join(offsets, [patient, slide]).withColumn("x_all", F.col(x) + F.col("_off")).drop("_off")


def budget_take(rows: DataFrame, by: list[str], order: str, key: str, size: str, most: int, room: int) -> DataFrame:
    """Rows of each group that a greedy pass in order takes: while fewer than ``most`` are taken and the row still fits into ``room``.

    A row that doesn't fit is passed over and later smaller ones may fit. Rows of size 0 or null are never taken.
    """

    def step(state: Column, r: Column) -> Column:
        fits = (F.size(state["keys"]) < most) & (state["used"] + r["s"] <= room)
        return F.struct(F.when(fits, state["used"] + r["s"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["keys"], F.array(r["k"]))).otherwise(state["keys"]).alias("keys"))

    kind = dict(rows.dtypes)[key]
    # what can never be taken doesn't enter a group's list
    small = rows.filter((F.col(size) > 0) & (F.col(size) <= room))
    listed = small.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(size).cast("long").alias("s")))).alias("_list"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("keys"))
    taken = listed.select(*by, F.aggregate("_list", start, step)["keys"].alias("_keys"))
    return taken.select(*by, F.posexplode("_keys").alias("taken", key))


def attention_mean(rows: DataFrame, by: list[str], key: str, attention: str, vector: str, k: int = 25) -> DataFrame:
    """Element-wise mean of the vectors of a bag's k rows with the most attention, ties to the smaller key: (by, position, value)."""
    order = Window.partitionBy(*by).orderBy(F.desc(attention), key)
    top = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return top.select(*by, F.posexplode(vector).alias("position", "x")).groupBy(*by, "position").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def histogram_percentile(bins: DataFrame, by: list[str], bin_: str, n: str, percent: float, last: int = 255) -> DataFrame:
    """The first bin at which the running count reaches a share of all; ``last`` for an empty histogram."""
    w = Window.partitionBy(*by)  # a row a bin
    placed = bins.withColumn("_c", F.sum(n).over(w.orderBy(bin_))).withColumn("_all", F.sum(n).over(w))
    reached = F.min(F.when(F.col("_c") >= F.col("_all") * (percent / 100), F.col(bin_)))
    return placed.groupBy(*by).agg(F.when(F.max("_all") > 0, reached).otherwise(F.lit(last)).alias("bin"))


def fingerprint(rows: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """Sixteen hex digits that change with any row of a group: the digest of the sorted digests' sum and of their count.

    Digests are summed, so no task lists a group's rows.
    """
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    s = rows.groupBy(*by).agg(F.sum(one).alias("_s"), F.count("*").alias("_n"))
    return s.select(*by, F.substring(F.sha2(F.concat_ws("|", F.col("_s").cast("string"), F.col("_n").cast("string")), 256), 1, 16).alias("fingerprint"))


def best_file(files: DataFrame, by: list[str], path: str, preferred: list[str]) -> DataFrame:
    """One file of each group: preferred types first, then those whose folder has a data folder, the shallower, the shorter, the first by name."""
    low = F.lower(path)
    rank = F.coalesce(*[F.when(F.endswith(low, F.lit(s)), F.lit(i)) for i, s in enumerate(preferred)], F.lit(len(preferred)))
    depth = F.size(F.split(path, "/"))
    key = F.struct(rank.alias("a"), (~F.coalesce(F.col("has_sibling_dir"), F.lit(False))).alias("b"), depth.alias("c"), F.length(path).alias("d"), F.col(path).alias("e"))
    return files.groupBy(*by).agg(F.min_by(path, key).alias(path))


def padded(values: Column, size: int, fill: Column) -> Column:
    """The first ``size`` entries of an array, filled up on the right."""
    return F.concat(F.slice(values, 1, size), F.array_repeat(fill, F.greatest(F.lit(size) - F.size(values), F.lit(0)).cast("int")))


def absolute_loss(truth: Column, predicted: Column) -> Column:
    """|predicted - truth|; null where the truth is null, no number or NaN."""
    t = truth.cast("string").try_cast("double")
    return F.when(t.isNotNull() & ~F.isnan(t), F.abs(predicted - t))


def prediction_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows numbered by loss, the least first and nulls last; ties by patient."""
    order = [F.col("loss").asc_nulls_last(), F.col("patient")]
    placed = running(ranged(rows.select(*by, "patient", *[c for c in rows.columns if c not in (*by, "patient")]), by, *order), by, order, place=F.lit(1))
    return placed.drop("_p")
