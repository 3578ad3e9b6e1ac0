"""Rules that look back over a run's own log, applied in event-time order to a stream that mixes times.

A run's rows wait in list state until the watermark has passed them; an event-time
timer then hands them in order to a rule, whose own list, map or value state is all that
is kept of the past. Rows that arrive behind the watermark are dropped and counted by
Spark (``late_rows``). A run without rows for longer than its gap begins anew, and a second timer
clears its state, so state is bounded by the open runs. The rows that come out don't depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: What Spark's keyed state with lists, maps and timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunLengths:
    """Rows since the value last changed: (run). ``row`` holds value."""

    fields, out = {"value": "string"}, "run int"

    def open(self, handle) -> None:
        self.state = handle.getValueState("last", "value string, run int")

    def load(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, 0]

    def save(self, memory: list) -> None:
        self.state.update(tuple(memory))

    def clear(self) -> None:
        self.state.clear()

    def fresh(self) -> list:
        return [None, 0]

    def take(self, memory: list, row: dict[str, Any]) -> tuple:
        memory[:] = [row["value"], memory[1] + 1 if memory[1] and memory[0] == row["value"] else 1]
        return (memory[1],)


class RegionLedger:
    """Which marked regions a run keeps: (outcome, n_kept, near).

    A mark is refused at the cap, or if its centre lies nearer than half its longer side to that of a kept
    region, whose id ``near`` names (the first of them). A discard takes the last kept region back; from one below the target on only if that
    region shows hardly any tissue. Any other step passes until the target is reached, after which the run has to come to its end.
    """

    # The outcomes' names and the tissue under which a region counts as empty.
    CAP, FINISH, DUPLICATE, BLOCKED = "max_accepted_rois_reached", "finalization_required", "duplicate_roi", "discard_blocked_near_target"
    EMPTY = 0.15

    fields = {"action": "string", "x": "long", "y": "long", "w": "long", "h": "long", "tissue": "double"}
    out = "outcome string, n_kept int, near long"

    def __init__(self, cap: int, target: int):
        self.cap, self.target = cap, target

    def open(self, handle) -> None:
        self.state = handle.getListState("kept", "id long, cx long, cy long, empty boolean")

    def load(self) -> list[tuple]:
        return [tuple(k) for k in self.state.get()] if self.state.exists() else []

    def save(self, memory: list[tuple]) -> None:
        if memory:
            self.state.put(memory)
        else:
            self.state.clear()

    def clear(self) -> None:
        self.state.clear()

    def fresh(self) -> list[tuple]:
        return []

    def take(self, kept: list[tuple], row: dict[str, Any]) -> tuple:
        near = None
        if row["action"] == "mark":
            cx, cy, apart = row["x"] + row["w"] // 2, row["y"] + row["h"] // 2, max(row["w"], row["h"]) / 2
            near = next((i for i, a, b, _ in kept if (cx - a) ** 2 + (cy - b) ** 2 < apart**2), None)
            if len(kept) >= self.cap:
                outcome, near = self.CAP, None
            elif near is not None:
                outcome = self.DUPLICATE
            else:
                outcome = "kept"
                kept.append((row["id"], cx, cy, row["tissue"] is not None and row["tissue"] < self.EMPTY))
        elif row["action"] == "discard":
            if not kept:
                outcome = "none_kept"
            elif len(kept) >= max(1, self.target - 1) and not kept[-1][3]:
                outcome = self.BLOCKED
            else:
                outcome = "discarded"
                kept.pop()
        else:
            outcome = self.CAP if len(kept) >= self.cap else self.FINISH if len(kept) >= self.target else "ok"
        return outcome, len(kept), near


class AttemptedBoxes:
    """Which boxes a run has tried: (first_id, n_boxes), the step that tried a box first and how many boxes the run has tried by then.

    Boxes without an area aren't remembered and have no first step. Kept in map state, of which only the asked boxes are read.
    """

    fields, out = {"x": "long", "y": "long", "w": "long", "h": "long"}, "first_id long, n_boxes int"

    def open(self, handle) -> None:
        self.boxes = handle.getMapState("boxes", "x long, y long, w long, h long", "id long")
        self.count = handle.getValueState("count", "n int")

    def load(self) -> list[int]:
        return [self.count.get()[0] if self.count.exists() else 0]

    def save(self, memory: list[int]) -> None:
        self.count.update((memory[0],))

    def clear(self) -> None:
        self.boxes.clear()
        self.count.clear()

    def fresh(self) -> list[int]:
        self.clear()
        return [0]

    def take(self, memory: list[int], row: dict[str, Any]) -> tuple:
        box = tuple(row[c] for c in ("x", "y", "w", "h"))
        if None in box or box[2] <= 0 or box[3] <= 0:
            return None, memory[0]
        if self.boxes.containsKey(box):
            return self.boxes.getValue(box)[0], memory[0]
        self.boxes.updateValue(box, (row["id"],))
        memory[0] += 1
        return row["id"], memory[0]


class _InOrder(StatefulProcessor):
    """Hands a key's rows to its rule in order of (at, id) as the watermark passes them; ``at`` and ``gap`` are microseconds."""

    def __init__(self, rule, gap: int, key: str, id_: str):
        self.rule, self.gap, self.names = rule, gap, ["at", "id", *rule.fields]
        self.row = Row(key, id_, *[part.split()[0] for part in rule.out.split(", ")])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, " + ", ".join(f"{n} {t}" for n, t in self.rule.fields.items()))
        self.last = handle.getValueState("last_at", "at long")
        self.rule.open(handle)

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.names) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due = [r for r in held if r[0] <= passed]
        last = self.last.get()[0] if self.last.exists() else None
        if due:
            memory = self.rule.load()
            for r in due:
                if last is not None and r[0] - last > self.gap:
                    memory = self.rule.fresh()
                last = r[0]
                yield self.row(*key, r[1], *self.rule.take(memory, dict(zip(self.names, r))))
            self.rule.save(memory)
            self.last.update((last,))
            rest = held[len(due) :]
            if rest:
                self.waiting.put(rest)
                self._wake(rest[0][0])
            else:
                self.waiting.clear()
        if last is not None and last + self.gap < passed:
            self.rule.clear()
            self.last.clear()
        elif due:
            self._wake(last + self.gap + 1000)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, time: str, id_: str, rule, late: str = "10 minutes", gap: str = "1 day", **columns) -> DataFrame:
    """(key, id_, what the rule says) of every row, in event-time order of each key's runs.

    ``columns`` give the rule's fields. Rows with a null id or time only move the watermark: a closing row of that kind, later than the log by more than
    ``late``, lets a finished log out to its end. A null key is a key of its own. Rows of one time go by their id.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    fields = [F.col(key), F.col(time), F.unix_micros(time).alias("at"), F.col(id_).cast("long").alias("id"), *[columns[n].cast(t).alias(n) for n, t in rule.fields.items()]]
    # a condition on the time itself stays above the watermark, which closing rows have to move first
    real = F.when(F.col(time).isNotNull(), F.col(id_)).isNotNull()
    rows = events.withWatermark(time, late).filter(real).select(*fields)
    micros = int(events.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap}) AS m").first()[0])
    return rows.groupBy(key).transformWithState(_InOrder(rule, micros, key, id_), f"`{key}` {kinds[key]}, `{id_}` long, {rule.out}", "append", "eventTime")


def keyed_state(spark: SparkSession):
    """Within it, queries start with the state store that keyed lists, maps and timers need; the session's own setting comes back after."""

    class Held:
        def __enter__(self):
            self.before = spark.conf.get(PROVIDER[0], None)
            spark.conf.set(*PROVIDER)

        def __exit__(self, *_):
            if self.before is None:
                spark.conf.unset(PROVIDER[0])
            else:
                spark.conf.set(PROVIDER[0], self.before)

    return Held()


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished or running query dropped behind the watermark, over the batches Spark still reports."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
