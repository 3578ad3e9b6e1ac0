"""Running sums, places and percentiles of long groups.

A window over a group is one task, however long the group. Here rows are range-partitioned by group
and order, summed up within each partition, and shifted by what the partitions before hold, so a group
is as many tasks as it has partitions. Partition numbers are settled in a table first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled

#: The column that holds the range partition of a row.
PART = "_p"


def with_group(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, a row a group, by equal keys; null keys are equal. Without keys right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def ranged(rows: DataFrame, by: list[str], *order: Column, to: str = PART) -> DataFrame:
    """rows with their range partition by group and order; equal keys share one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn(to, F.spark_partition_id()), "ranged")


def running(dealt: DataFrame, by: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """Adds running sums over each group, the present row among them; ``dealt`` comes from ``ranged`` in the same order.

    Rows with equal order are taken one after another, so the order should be without ties.
    """
    local = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({name: F.sum(c).over(local) for name, c in sums.items()})
    # a row for each partition of a group
    totals = dealt.groupBy(PART, *by).agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(PART, *by, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    joined = with_group(placed, before, [PART, *by])
    return joined.select(*dealt.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def _counts_upto(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _n, _c, _all): distinct values that aren't null, how often each occurs, how many rows have it or less, and all of the group."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = running(ranged(counted, by, F.col(value)), by, [F.col(value)], _c=F.col("_n"))
    return with_group(upto, counted.groupBy(*by).agg(F.sum("_n").alias("_all")), by)


def lower_median(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The lower of the two middle values of each group, or the middle one; nulls don't count."""
    middle = F.floor((F.col("_all") - 1) / 2)
    held = _counts_upto(rows, by, value).filter((middle >= F.col("_c") - F.col("_n")) & (middle < F.col("_c")))
    return held.select(*by, F.col(value).alias(name))


def quantiles(rows: DataFrame, by: list[str], value: str, **at: float) -> DataFrame:
    """Exact percentiles with linear interpolation, a row a group; nulls don't count.

    The two ranks around each percentile are looked up in running counts of distinct values.
    """
    both = _counts_upto(rows, by, value)
    place = {name: F.lit(float(q)) * (F.col("_all") - 1) for name, q in at.items()}
    holds = lambda k: (k >= F.col("_c") - F.col("_n")) & (k < F.col("_c"))
    found = both.groupBy(*by).agg(
        *[F.max(F.when(holds(F.floor(p)), F.col(value))).alias(f"_lo_{name}") for name, p in place.items()],
        *[F.max(F.when(holds(F.ceil(p)), F.col(value))).alias(f"_hi_{name}") for name, p in place.items()],
        *[F.max(p - F.floor(p)).alias(f"_part_{name}") for name, p in place.items()],
    )
    return found.select(*by, *[(F.col(f"_lo_{n}") + F.col(f"_part_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in at])


def _won(t: np.ndarray, r: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(pairs with t_i < t_j and r_i > r_j, and those with r_i = r_j), weighted d_i n_j; by halves of the times."""
    if len(t) < 2 or t[0] == t[-1]:
        return 0.0, 0.0
    if len(t) <= 256:
        pair = (t[:, None] < t[None, :]) * d[:, None] * n[None, :]
        return float((pair * (r[:, None] > r[None, :])).sum()), float((pair * (r[:, None] == r[None, :])).sum())
    middle = t[len(t) // 2]
    cut = int(np.searchsorted(t, middle)) or int(np.searchsorted(t, middle, side="right"))
    early, late = slice(0, cut), slice(cut, len(t))
    order = np.argsort(r[late], kind="stable")
    sums = np.concatenate([[0], np.cumsum(n[late][order])])
    low, high = (sums[np.searchsorted(r[late][order], r[early], side=s)] for s in ("left", "right"))
    parts = [(float((d[early] * low).sum()), float((d[early] * (high - low)).sum())), _won(*(x[early] for x in (t, r, d, n))), _won(*(x[late] for x in (t, r, d, n)))]
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def concordance(rows: DataFrame, by: list[str], time: str, event: str, risk: str) -> DataFrame:
    """Pairs with an event at the earlier time: (by, won, tied), where won counts those with the larger risk earlier.

    No pairs are formed. Times and risks are cut into ranges. Pairs from different ranges of both are products of
    cell counts; pairs within one range of times or of risks are counted by halving, a range a task. Rows are
    first summed over equal (time, risk).
    """
    at = rows.groupBy(*by, F.col(time).alias("t"), F.col(risk).alias("r")).agg(F.sum(event).alias("d"), F.count("*").alias("n"))
    dealt = ranged(ranged(at, by, F.col("t"), to="tb"), by, F.col("r"), to="rb")
    keys = [*by, "tb", "rb"]

    def local(name: str, t: str) -> DataFrame:
        def count(group: pd.DataFrame) -> pd.DataFrame:
            g = group.sort_values("t", kind="stable")
            won, tied = _won(*(g[c].to_numpy() for c in ("t", "r")), *(g[c].to_numpy(float) for c in ("d", "n")))
            return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "won": [won], "tied": [tied]})

        kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
        summed = dealt.groupBy(*by, name, F.col(t).cast("double").alias("t"), F.col("r").cast("double").alias("r")).agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
        return summed.groupBy(*by, name).applyInPandas(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "won double", "tied double"]))

    cells = dealt.groupBy(*keys).agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    # every time range with every risk range of its group: partitions squared at most
    full = cells.select(*by, "tb").distinct().withColumnRenamed("tb", "x").join(cells.select(*by, "rb").distinct().withColumnRenamed("rb", "y"), by) if by else cells.select(F.col("tb").alias("x")).distinct().crossJoin(cells.select(F.col("rb").alias("y")).distinct())
    grid = full.join(cells.withColumnRenamed("tb", "x").withColumnRenamed("rb", "y"), [*by, "x", "y"], "left").na.fill(0, ["d", "n"])
    lower = grid.withColumn("low", F.coalesce(F.sum("n").over(Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = lower.withColumn("s", F.coalesce(F.sum("low").over(Window.partitionBy(*by, "y").orderBy("x").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    apart = later.groupBy(*by).agg(F.sum(F.col("d") * F.col("s")).cast("double").alias("won"), F.lit(0.0).alias("tied"))
    return apart.unionByName(local("tb", "t")).unionByName(local("rb", "tb")).groupBy(*by).agg(F.sum("won").alias("won"), F.sum("tied").alias("tied"))
