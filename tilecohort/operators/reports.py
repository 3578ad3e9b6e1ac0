"""From prediction tables to statistics tables: per fold and class, aggregated over folds, and for survival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_interval_half
from . import metrics
from .ordered import quantiles, with_group

# Slide-name prefixes and decision texts of the evaluation.
TRUTH_PREFIXES = [("aml", "AML"), ("normaleskm", "Normal marrow")]
DECISION_LABELS = [("Acute Leukemia", "AML"), ("Acute leukemia", "AML"), ("Normal Bone Marrow", "Normal marrow"), ("Normal marrow", "Normal marrow"), ("Call for more diagnostics", "Call for more diagnostics")]
UNKNOWN = "Unknown"


def truth_of_name(name: Column) -> Column:
    """The class that a slide's name begins with, else Unknown."""
    return F.coalesce(*[F.when(F.startswith(F.lower(name), F.lit(p)), F.lit(c)) for p, c in TRUTH_PREFIXES], F.lit(UNKNOWN))


def predicted_label(decision: Column, status: Column) -> Column:
    """The class of a decision; a finished run without one asks for more diagnostics."""
    label = F.coalesce(*[F.when(decision == d, F.lit(c)) for d, c in DECISION_LABELS], F.lit(UNKNOWN))
    return F.when((label == UNKNOWN) & (status == "ok"), F.lit("Call for more diagnostics")).otherwise(label)


def run_rows(runs: DataFrame, name: str = "slide_name", decision: str = "final_decision", status: str = "status") -> DataFrame:
    """runs with ground truth, predicted label, whether they count in statistics, and whether they are right; a null status is missing."""
    held = F.coalesce(F.col(status), F.lit("missing"))
    placed = runs.withColumn("summary_status", held).withColumn("ground_truth", truth_of_name(F.col(name))).withColumn("predicted_label", predicted_label(F.col(decision), F.col("summary_status")))
    right = (F.col("summary_status") == "ok") & F.col("predicted_label").isin(sorted({c for _, c in TRUTH_PREFIXES})) & (F.col("predicted_label") == F.col("ground_truth"))
    return placed.withColumn("included_in_statistics", F.col("summary_status") != "error").withColumn("is_correct", right)


def detected_targets(columns: list[str]) -> list[str]:
    """Columns that have a prediction column beside them, in order of name."""
    return sorted(c.removeprefix("pred_") for c in columns if c.startswith("pred_") and c.removeprefix("pred_") in columns)


def long_predictions(rows: DataFrame, targets: list[str], classes: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """(keep, target, truth, class, score, predicted) of wide rows with columns target and target_class; rows without a truth are left out.

    predicted is the first class with the largest score.
    """
    parts = []
    for t in targets:
        scores = F.array(*[F.col(f"{t}_{c}").cast("double") for c in classes[t]])
        names = F.array(*map(F.lit, classes[t]))
        each = F.explode(F.arrays_zip(names.alias("class"), scores.alias("score"))).alias("x")
        parts.append(rows.filter(F.col(t).isNotNull()).select(*keep, F.lit(t).alias("target"), F.col(t).alias("truth"), metrics.argmax_class(scores, names).alias("predicted"), each).select(*keep, "target", "truth", "predicted", "x.class", "x.score"))
    return reduce(DataFrame.unionByName, parts)


def _joined(tables: list[DataFrame], by: list[str]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = with_group(out, t, by, "left")
    return out


def categorical_table(long: DataFrame, by: list[str]) -> DataFrame:
    """One-against-rest statistics of each class of a fold: count, AUROC, average precision, F1, and p of a t-test between the two sides' scores.

    A class without a row in its group is left out, as classes come from the truths.
    """
    keys = [*by, "class"]
    is_class = (F.col("truth") == F.col("class")).cast("int")
    rows = long.withColumn("is", is_class)
    said = F.col("predicted") == F.col("class")
    counts = rows.groupBy(*keys).agg(F.sum("is").alias("count"), F.count_if(said & (F.col("is") == 1)).alias("tp"), F.count_if(said | (F.col("is") == 1)).alias("any")).filter("count > 0")
    base = counts.select(*keys, "count", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("any") + F.col("tp")), F.lit(0.0)), 6).alias("f1_score"))
    area = metrics.auroc(rows, keys, "is", "score").withColumnRenamed("auroc", "roc_auc_score")
    precision = metrics.average_precision(rows, keys, "is", "score").withColumnRenamed("average_precision", "average_precision_score")
    p = metrics.t_statistic(rows, keys, "is", "score").select(*keys, F.round("p", 6).alias("p_value"))
    return _joined([base, area, precision, p], keys)


SCORES = ["roc_auc_score", "average_precision_score", "f1_score"]


def over_folds(table: DataFrame, by: list[str], values: list[str], count: str | None = None) -> DataFrame:
    """Mean and 95 % t interval of each value over folds (null for one fold), and the sum of counts; a row for each group and value."""
    long = table.select(*by, *([count] if count else []), F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select(*by, *([count] if count else []), "m.*")
    n = F.count("value")
    s = long.groupBy(*by, "metric").agg(n.alias("folds"), F.avg("value").alias("mean"), F.when(n > 1, F.stddev_samp("value") / F.sqrt(n)).alias("sem"), *([F.sum(count).alias("count")] if count else []))
    half = t_interval_half("sem", (F.col("folds") - 1).cast("double"))
    return s.select(*by, "metric", "folds", F.round("mean", 8).alias("mean"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"), *([F.col("count")] if count else []))


def survival_table(rows: DataFrame, by: list[str], time: str, event: str, risk: str, cut_off: float | None = None) -> DataFrame:
    """C-index, log-rank p between risks up to and over a cut-off (the median where none is given), counts and threshold of each group.

    Rows with a null, or a status other than 0 and 1, are left out.
    """
    valid = rows.na.drop(subset=[time, event, risk]).filter(F.col(event).isin(0, 1))
    if cut_off is None:
        cut = quantiles(valid, by, risk, threshold=0.5)
    else:
        cut = valid.select(*by).distinct().withColumn("threshold", F.lit(float(cut_off)))
    split = with_group(valid, cut, by).withColumn("_high", (F.col(risk) > F.col("threshold")).cast("int"))
    counts = split.groupBy(*by).agg(F.count("*").alias("count"), F.sum(event).cast("long").alias("events"), F.count_if(F.col(event) == 0).alias("censored"))
    index = metrics.c_index(valid, by, time, event, risk).withColumnRenamed("pairs", "comparable_pairs")
    return _joined([counts, index, metrics.logrank_by(split, by, "_high", time, event).select(*by, F.round("p", 6).alias("logrank_p")), cut.select(*by, F.round("threshold", 6).alias("threshold"))], by)


def filter_statistics(rows: DataFrame, by: list[str], selected: Column, values: list[str]) -> DataFrame:
    """How many rows came in and were selected, their share, and means of values over all and over selected rows."""
    s = rows.withColumn("_s", F.coalesce(selected, F.lit(False)))
    means = [f.alias(n) for v in values for f, n in ((F.round(F.avg(v), 6), f"mean_{v}"), (F.round(F.avg(F.when(F.col("_s"), F.col(v))), 6), f"mean_{v}_selected"))]
    return s.groupBy(*by).agg(F.count("*").alias("n_in"), F.count_if("_s").alias("n_selected"), F.round(F.try_divide(F.count_if("_s"), F.count("*")), 6).alias("fraction"), *means)


def status_tally(rows: DataFrame, by: list[str], status: str) -> DataFrame:
    """Runs of each group that ended ok, in error, or were skipped, and all of them."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("ok", "error", "skip")], F.count("*").alias("total"))


def bag_summary(rows: DataFrame, by: list[str], bag: str) -> DataFrame:
    """Bags of a group, rows in all of them, and the least, mean and most rows of one."""
    n = rows.groupBy(*by, bag).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.count("*").alias("bags"), F.sum("n").alias("rows"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def good_runs(runs: DataFrame, regions: str = "roi_count", decision: str = "final_decision") -> DataFrame:
    """Runs with a region at least and a decision that isn't marked unavailable."""
    said = F.trim(F.coalesce(F.col(decision), F.lit("")))
    return runs.filter((F.coalesce(F.col(regions), F.lit(0)) >= 1) & (said != "") & ~F.lower(said).contains("unavailable"))


def pending(work: DataFrame, done: DataFrame, key: list[str], status: str = "status", regions: str | None = None, target: int = 0) -> DataFrame:
    """Work that hasn't ended ok (with ``regions``: with at least ``target`` of them) yet."""
    finished = done.filter(F.col(status) == "ok")
    if regions:
        finished = finished.filter(F.col(regions) >= target)
    return work.join(finished.select(*key).distinct(), key, "left_anti")


def messages(rows: DataFrame, by: list[str], position: str, role: str, text: str) -> DataFrame:
    """(by, messages): system texts joined by a blank line into one leading message, then the others in order.

    Blank system texts are left out; without any there is no leading message.
    """
    system = F.col(role) == "system"
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    s = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(system & (body != ""), F.struct(F.col(position).alias("i"), body.alias("t"))))).alias("lead"),
        F.array_sort(F.collect_list(F.when(~system, F.struct(F.col(position).alias("i"), F.col(role).alias("role"), F.col(text).alias("content"))))).alias("rest"),
    )
    first = F.array_join(F.transform("lead", lambda x: x["t"]), "\n\n")
    lead = F.when(F.size("lead") > 0, F.array(F.struct(F.lit("system").alias("role"), first.alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return s.select(*by, F.concat(lead, F.transform("rest", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"))
