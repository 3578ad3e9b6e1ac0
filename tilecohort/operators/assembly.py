"""Patient, slide and label tables: null rules, joins, checks, targets, folds and bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranged, running

# Tokens that count as null, and status words.
NA_TOKENS = ["", "NA", "N/A", "NaN", "nan", "na", "n/a", "None", "none", "NULL", "null", "#N/A", "#NA", "=#VALUE!", "-NaN", "-nan", "<NA>", "?", "-", "--"]
EVENT_WORDS = ["1", "event", "dead", "deceased", "yes", "y", "true"]
CENSORED_WORDS = ["0", "alive", "censored", "no", "false"]


def null_tokens(c: Column) -> Column:
    return F.when(F.trim(c).isin(NA_TOKENS), None).otherwise(c)


def survival_status(c: Column) -> Column:
    """1 for an event, 0 for censored, null for null; numbers count as events above 0; other words raise."""
    word = F.lower(F.trim(c.cast("string")))
    number = word.try_cast("double")
    return F.when(null_tokens(c.cast("string")).isNull(), None).when(word.isin(EVENT_WORDS), 1).when(word.isin(CENSORED_WORDS), 0).when(number.isNotNull(), (number > 0).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), word)).cast("int"))


def labelled(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Rows with a label: of one target its own, of several any."""
    return rows.na.drop(how="any" if len(targets) == 1 else "all", subset=targets)


def unique_key(rows: DataFrame, key: str) -> DataFrame:
    """rows; the query fails if a key repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("long")).otherwise(n)).filter("_n = 1").drop("_n")


def complete_patients(patients: DataFrame, slides: DataFrame, features: DataFrame, patient: str, slide: str) -> DataFrame:
    """Patients with a label and with slides whose feature file exists, and those slides in order."""
    held = slides.join(features.select(slide), slide, "left_semi").groupBy(patient).agg(F.array_sort(F.collect_set(slide)).alias("slides"))
    return patients.join(held, patient)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(key), key, "left_anti")


def present(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right has (the leakage check between splits)."""
    return left.join(right.select(key), key, "left_semi")


def first_of(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first by order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def two_hops(cases: DataFrame, first: DataFrame, second: DataFrame, on: tuple[str, str], fill: list[str]) -> DataFrame:
    """Left joins over two tables; missing strings become empty."""
    joined = cases.join(first, on[0], "left").join(second, on[1], "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in fill else F.col(c) for c in joined.columns])


def multiset_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, digits: int = 5) -> DataFrame:
    """Joins rows of equal rounded coordinates, the k-th of one side with the k-th of the other; rows without a partner stay with nulls."""
    sides = []
    for side, name in ((left, "left_pos"), (right, "right_pos")):
        rounded = [F.round(k, digits).alias(k) for k in keys]
        n = F.row_number().over(Window.partitionBy(*[F.round(k, digits) for k in keys]).orderBy(order))
        sides.append(side.select(*rounded, n.alias("nth"), F.col(order).alias(name)))
    return sides[0].join(sides[1], [*keys, "nth"], "full")


def class_counts(rows: DataFrame, target: str) -> DataFrame:
    return rows.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, target: str) -> DataFrame:
    """Reciprocal class shares, scaled to sum 1; a row a class."""
    n = class_counts(rows, target)
    all_ = Window.partitionBy()  # a row a class
    return n.select("class", "n", F.round((1 / F.col("n")) / F.sum(1 / F.col("n")).over(all_), 6).alias("weight"), (F.col("n") < 16).alias("underpopulated"))


def one_hot(c: Column, categories: list[str]) -> Column:
    """1 at the category's place; null gives zeros."""
    return F.array(*[F.when(c == F.lit(k), 1).otherwise(0) for k in categories])


def stratified_folds(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """Deals the rows of each stratum out to k folds in turn."""
    placed = running(ranged(rows, by, *order), by, list(order), _i=F.lit(1))
    return placed.select(*rows.columns, F.pmod(F.col("_i") - 1, F.lit(k)).cast("int").alias("fold"))


def equidistant_bag(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """At most k rows of each bag: all, or those nearest k equal steps from first to last (half to even); ``slot`` numbers them.

    With k = 1 the first row of a longer bag stays.
    """
    if k < 1:
        raise ValueError("a bag holds a row at least")
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # the slot that would pick a row: steps are (n - 1) / (k - 1) apart
    step = (F.col("_n") - 1) / F.lit(float(k - 1)) if k > 1 else F.col("_n").cast("double")
    slot = F.explode(F.when(F.col("_n") <= k, F.array("_i")).otherwise(F.filter(F.sequence(F.greatest(F.floor((F.col("_i") - 1) / step), F.lit(0)), F.least(F.ceil((F.col("_i") + 1) / step), F.lit(k - 1))), lambda s: F.bround(s * step) == F.col("_i"))))
    return placed.select(*rows.columns, slot.alias("slot")).withColumn("slot", F.col("slot").cast("int"))


def chunks(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """Numbers rows in order into ``parts`` chunks of ceil(n / parts) rows, the last one shorter.

    Ranks come from partition counts after a range partitioning, so no task orders the whole table.
    """
    placed = running(ranged(rows, [], F.col(order)), [], [F.col(order)], _i=F.lit(1))
    total = F.broadcast(rows.agg(F.count("*").alias("_all")))  # one row
    return placed.crossJoin(total).select(*rows.columns, F.floor((F.col("_i") - 1) / F.ceil(F.col("_all") / F.lit(float(parts)))).cast("int").alias("chunk"))


def ensemble_mean(rows: DataFrame, key: str, scores: str) -> DataFrame:
    """Element-wise mean of score arrays over the models of a key."""
    each = rows.select(key, F.posexplode(scores).alias("p", "x")).groupBy(key, "p").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: F.round(s["x"], 6)).alias(scores))


def double_softmax_loss(probabilities: Column, truth: Column) -> Column:
    """Cross-entropy that takes probabilities for logits; truth counts from 0."""
    return -F.element_at(probabilities, truth + 1) + F.log(F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + F.exp(p)))
