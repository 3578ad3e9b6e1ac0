"""Ordered step logs: look-back counts, runs and bounded history. The batch forms; ``streaming.steps`` has the stateful ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK, HISTORY = 12, 8


def lookback_count(rows: DataFrame, by: str, order: list[str], event: Column, to: str, size: int = LOOKBACK) -> DataFrame:
    """How many of the last ``size`` rows, the present one among them, are such events."""
    return rows.withColumn(to, F.count_if(event).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - size, 0)))


def run_length(rows: DataFrame, by: str, order: list[str], value: str, to: str) -> DataFrame:
    """Rows since the value last changed, the present one among them."""
    w = Window.partitionBy(by).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    placed = rows.withColumn("_i", F.row_number().over(w)).withColumn("_c", F.when(F.row_number().over(w) == 1, 1).otherwise(changed))
    last = F.max(F.when(F.col("_c") == 1, F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(to, F.col("_i") - last + 1).drop("_i", "_c")


def trailing_run(rows: DataFrame, by: str, order: list[str], holds: Column) -> DataFrame:
    """For each group, how many of its last rows in a row hold the condition."""
    down = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    placed = rows.select(by, F.row_number().over(down).alias("i"), F.coalesce(holds, F.lit(False)).alias("h"))
    return placed.groupBy(by).agg((F.coalesce(F.min(F.when(~F.col("h"), F.col("i"))), F.count("*") + 1) - 1).alias("run"))


def last_rows(rows: DataFrame, by: str, order: list[str], size: int = HISTORY) -> DataFrame:
    """The last ``size`` rows of each group; ``age`` counts from 1, the last row."""
    down = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("age", F.row_number().over(down)).filter(F.col("age") <= size)


def budget(rows: DataFrame, navigation: str, same_region: str) -> DataFrame:
    """Over budget from 6 navigation steps or 1 step in the same region; warning tiers at 3 and 5."""
    tier = F.when(F.col(same_region) >= 5, 2).when(F.col(same_region) >= 3, 1).otherwise(0)
    return rows.withColumn("over_budget", (F.col(navigation) >= 6) | (F.col(same_region) >= 1)).withColumn("warning", tier)
