"""Queries over the event log as a stream whose parts mix times: rules in event-time order, each part read after a restart from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import new_path
from ..streaming import rules
from .catalogue import _RUNS, query, table


def in_parts(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What a stream gives whose source grows by one part after another; each part is read by a query that starts from the checkpoint the one before left."""
    base = new_path(spark, label)
    with rules.keyed_state(spark):
        for i, part in enumerate(parts):
            part.write.parquet(f"{base}/in/part={i}")
            stream = spark.readStream.schema(parts[0].schema).parquet(f"{base}/in/*")
            run = build(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/out").start()
            run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _mixed_log(spark: SparkSession, sf_dir: str, n: int = 2) -> list[DataFrame]:
    """The events in n parts by a time that a hash of the id shifts by up to twelve hours, and a closing row."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    shifted = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(12 * 3600 * 1_000_000))
    ends = events.agg(F.min(shifted).alias("lo"), F.max(shifted).alias("hi"), F.max("ts").alias("last")).first()
    if ends.lo is None:
        return [events]
    part = F.least(F.floor((shifted - ends.lo) * n / (ends.hi - ends.lo + 1)), F.lit(n - 1))
    closing = spark.range(1).select(*[(F.lit(ends.last) + F.expr("INTERVAL 30 DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    return [events.filter(part == i) for i in range(n)] + [closing]


def _step() -> dict[str, Column]:
    """A log step as region marks: its kind, a box on a grid, and its tissue share."""
    return {
        "action": F.when(F.col("event_type").isin("view", "click", "signup"), "mark").when(F.col("event_type") == "error", "discard").otherwise("navigate"),
        "x": F.col("event_id") * 37 % 40 * 100, "y": F.col("event_id") * 91 % 30 * 100, "w": F.lit(400), "h": 200 + F.col("event_id") % 5 * 150, "tissue": F.col("value") / 100,
    }


_STEP_SQL = """e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'mark' WHEN event_type = 'error' THEN 'discard' ELSE 'navigate' END AS action,
    event_id * 37 % 40 * 100 AS x, event_id * 91 % 30 * 100 AS y, 400 AS w, 200 + event_id % 5 * 150 AS h, value / 100 AS tissue,
    row_number() OVER o AS i, coalesce(ts - lag(ts) OVER o > INTERVAL 1 DAY, TRUE) AS anew FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(_RUNS)
def stream_run_length_mixed(spark, sf_dir):
    """The run length from a source that mixes times within the watermark."""
    build = lambda s: rules.in_order(s, "user_id", "ts", "event_id", rules.RunLengths(), late="1 day", gap="10000 days", value=F.col("event_type"))
    return in_parts(spark, _mixed_log(spark, sf_dir), build, "mixed_runs").select("event_id", "user_id", "run")


@query(f"""WITH RECURSIVE {_STEP_SQL},
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, ''::VARCHAR AS outcome, NULL::BIGINT AS near, []::STRUCT(id BIGINT, cx BIGINT, cy BIGINT, bare BOOLEAN)[] AS kept FROM e
UNION ALL
SELECT user_id, i, event_id, outcome, CASE WHEN outcome = 'duplicate_roi' THEN near END,
    CASE outcome WHEN 'kept' THEN list_append(k, {{'id': event_id, 'cx': cx, 'cy': cy, 'bare': tissue < 0.15}}) WHEN 'discarded' THEN k[:len(k) - 1] ELSE k END
FROM (SELECT *, CASE action
        WHEN 'mark' THEN CASE WHEN len(k) >= 6 THEN 'max_accepted_rois_reached' WHEN near IS NOT NULL THEN 'duplicate_roi' ELSE 'kept' END
        WHEN 'discard' THEN CASE WHEN len(k) = 0 THEN 'none_kept' WHEN len(k) >= 3 AND NOT k[len(k)].bare THEN 'discard_blocked_near_target' ELSE 'discarded' END
        ELSE CASE WHEN len(k) >= 6 THEN 'max_accepted_rois_reached' WHEN len(k) >= 4 THEN 'finalization_required' ELSE 'ok' END END AS outcome
    FROM (SELECT *, list_filter(k, lambda b: (cx - b.cx) * (cx - b.cx) + (cy - b.cy) * (cy - b.cy) < greatest(w, h) * greatest(w, h) / 4.0)[1].id AS near
        FROM (SELECT e.*, x + w // 2 AS cx, y + h // 2 AS cy, CASE WHEN anew THEN [] ELSE r.kept END AS k FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1))))
SELECT user_id, event_id, outcome, len(kept)::INT AS n_kept, near FROM r WHERE i > 0""")
def stream_region_ledger(spark, sf_dir):
    """Cap, target, distance and discard rules over each user's runs, from a source that mixes times."""
    build = lambda s: rules.in_order(s, "user_id", "ts", "event_id", rules.RegionLedger(cap=6, target=4), late="1 day", gap="1 day", **_step())
    return in_parts(spark, _mixed_log(spark, sf_dir), build, "ledger")


@query(f"""WITH {_STEP_SQL.replace("event_id * 37 % 40 * 100 AS x, event_id * 91 % 30 * 100 AS y", "event_id % 3 * 100 AS x, event_id % 2 * 100 AS y")}, g AS (SELECT *, sum(anew::INT) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, run, x, y, h ORDER BY i) AS first_id FROM g)
SELECT user_id, event_id, first_id, sum((first_id = event_id)::INT) OVER (PARTITION BY user_id, run ORDER BY i ROWS UNBOUNDED PRECEDING)::INT AS n_boxes FROM f""")
def stream_attempted_boxes(spark, sf_dir):
    """Which boxes each run has tried before, from a source that mixes times."""
    coarse = _step() | {"x": F.col("event_id") % 3 * 100, "y": F.col("event_id") % 2 * 100}
    build = lambda s: rules.in_order(s, "user_id", "ts", "event_id", rules.AttemptedBoxes(), late="1 day", gap="1 day", **{n: coarse[n] for n in rules.AttemptedBoxes.fields})
    return in_parts(spark, _mixed_log(spark, sf_dir), build, "boxes")
