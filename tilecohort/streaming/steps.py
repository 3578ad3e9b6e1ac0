"""Step logs and events as streams: windows, sessions, and the stateful run length.

What the batch operators compute over a finished log these compute as it grows;
on the same input both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, key: str, value: str, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum of each key in tumbling (or sliding) windows; rows later than ``late`` are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that a gap without events ends."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, time: str, key: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def running_runs(events: DataFrame, key: str, order: str, value: str, id_: str) -> DataFrame:
    """Rows since the value of a key last changed, for every event; the state is the last value, its run and its place.

    Within a micro-batch a key's rows are put in order first, whatever Arrow batches they come in. Over
    micro-batches they must arrive in order: a row before one that was counted fails the query, for what was
    emitted can't be taken back. A source that mixes times needs a watermark and a window, as in ``tumbling``.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, at, at_id = state.get if state.exists else (None, 0, None, None)
        held = pd.concat(list(batches)).sort_values([order, id_])  # one key's rows of one micro-batch
        if not len(held):
            return
        first = held.iloc[0]
        if run and (first[order], first[id_]) <= (pd.Timestamp(at) if isinstance(first[order], pd.Timestamp) else at, at_id):
            raise ValueError(f"{key} {group[0]}: row {first[id_]} comes before one that was counted")
        value_of = held[value].to_numpy(object)
        change = np.ones(len(held), bool)
        change[1:] = value_of[1:] != value_of[:-1]
        change[0] = not run or value_of[0] != last
        start = np.where(change, np.arange(len(held)), -run)
        runs = np.arange(len(held)) - np.maximum.accumulate(start) + 1
        end = held.iloc[-1]
        state.update((value_of[-1], int(runs[-1]), end[order].to_pydatetime() if isinstance(end[order], pd.Timestamp) else end[order], end[id_].item() if hasattr(end[id_], "item") else end[id_]))
        yield pd.DataFrame({key: group[0], id_: held[id_].to_numpy(), "run": runs.astype(np.int32)})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {id_} {kinds[id_]}, run int", f"last {kinds[value]}, run int, at {kinds[order]}, at_id {kinds[id_]}", "append", GroupStateTimeout.NoTimeout)
