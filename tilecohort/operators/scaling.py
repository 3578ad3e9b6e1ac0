"""Scaling over a group: z-scores, robust unit scale, winsorising. Each is an aggregation and a join on the group; percentiles are exact and no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, with_group

FLAT = 1e-12


def zscore(x: Column, over) -> Column:
    """Population z-score; 0 where the spread is under 1e-12."""
    return F.when(F.stddev_pop(x).over(over) < FLAT, 0.0).otherwise((x - F.avg(x).over(over)) / F.stddev_pop(x).over(over))


def with_zscore(rows: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    return rows.withColumn(to, zscore(F.col(value), Window.partitionBy(*by)))


def unit_scale(rows: DataFrame, by: list[str], value: str, to: str, low: float = 0.10, high: float = 0.90, *, fall_back_to_range: bool = True) -> DataFrame:
    """Between two exact percentiles, cut to 0..1; where those coincide between least and greatest, and where those do 0.5."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    q = quantiles(rows, by, value, _lo=low, _hi=high)
    s = with_group(ends, q, by)
    if not fall_back_to_range:
        s = s.withColumns({"_min": F.col("_lo"), "_max": F.col("_hi")})
    flat = F.col("_hi") <= F.col("_lo")
    lo, hi = F.when(flat, F.col("_min")).otherwise(F.col("_lo")), F.when(flat, F.col("_max")).otherwise(F.col("_hi"))
    scaled = F.when(hi <= lo, 0.5).otherwise(F.least(F.greatest((F.col(value) - lo) / F.greatest(hi - lo, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0)))
    return with_group(rows, s, by).withColumn(to, scaled).drop("_lo", "_hi", "_min", "_max")


def winsorize(rows: DataFrame, by: list[str], value: str, to: str, percentile: float = 97.0) -> DataFrame:
    """Cuts values at an exact upper percentile; 100 or more leaves them."""
    if percentile >= 100:
        return rows.withColumn(to, F.col(value))
    top = quantiles(rows, by, value, _top=percentile / 100)
    return with_group(rows, top, by).withColumn(to, F.least(F.col(value), F.col("_top"))).drop("_top")
