"""Moving-window rate limit (WN7): at most ``most`` admitted events of a key in any ``seconds``; refused events don't count.

Both forms carry the same state for a key, its last ``most`` admitted times, through its events in order of
(time, event id), and give the same rows.

Batch: a key's events are cut into chains at pauses of the window's length. Pauses are looked for at borders of time cells,
of which a key has few rows, so a key that holds a third of all events is spread over tasks without sorting it in
one. A chain is scanned in sorted order by a task that holds the state and one Arrow batch: a chain of any length takes
constant memory, and chains where the limit is never reached are settled without a loop.

Stream: events wait in the key's state until the watermark has passed them and are then decided in order, by event-time
timers. So the result does not depend on how events are dealt to micro-batches. What arrives behind the watermark
is late: it is dropped by Spark, is neither admitted nor refused, and does not count. A key that is silent for the window has no state.

Defined results: a null key is a key like any other. An event without a time is refused and does not count (in a stream such events are
refused at once). Repeated rows are events of their own. Of equal times the smaller event id comes first, null before all.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Windows in a time cell; a pause inside a cell does not end a chain.
CELL_WINDOWS = 10


def decide(times: list[int] | np.ndarray, recent: deque[int], micros: int, most: int) -> list[bool]:
    """For sorted times: who is admitted. ``recent`` holds the last admitted times and is carried on."""
    out = []
    for t in times:
        while recent and recent[0] <= t - micros:
            recent.popleft()
        ok = len(recent) < most
        if ok:
            recent.append(int(t))
        out.append(ok)
    return out


def _chains(rows: DataFrame, micros: int) -> DataFrame:
    """Adds __chain: events of one key and chain are not more than a window apart, or share a cell."""
    cell = micros * CELL_WINDOWS
    placed = rows.withColumn("__cell", F.floor(F.col("at") / cell))
    ends = placed.groupBy("user_id", "__cell").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = W.partitionBy("user_id").orderBy("__cell")
    begins = F.coalesce((F.col("first") - F.lag("last").over(order) >= micros).cast("int"), F.lit(1))
    numbered = ends.withColumn("begins", begins).withColumn("__chain", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    cells = numbered.select(F.col("user_id").alias("__user"), F.col("__cell").alias("__c"), "__chain")
    return placed.join(cells, F.col("user_id").eqNullSafe(F.col("__user")) & (F.col("__cell") == F.col("__c"))).drop("__user", "__c", "__cell")


def admitted(events: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """(event_id, user_id, admitted) of a table of events (event_id, user_id, ts)."""
    if seconds < 1 or most < 1:
        raise ValueError("seconds and most are 1 or more")
    micros = seconds * 1_000_000
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, recent = None, deque()
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(2).to_numpy()
            group = b.select(["user_id", "__chain"])
            # Where the next chain begins; the first row may go on from the batch before.
            fresh = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                fresh[1:] = False
                for c in group.columns:
                    a, z = c.slice(1), c.slice(0, b.num_rows - 1)
                    differs = pc.fill_null(pc.not_equal(a, z), False).to_numpy(zero_copy_only=False)
                    fresh[1:] |= differs | (a.is_null().to_numpy(zero_copy_only=False) != z.is_null().to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(fresh)
            ok = np.ones(b.num_rows, bool)
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                key = tuple(c[int(s)].as_py() for c in group.columns)
                if key != held:
                    held, recent = key, deque()
                t = at[s:e]
                # No event has ``most`` others in its window, those of before included: all are admitted.
                known = np.concatenate([np.array(recent, np.int64), t])
                if (known[most:] - known[:-most] >= micros).all():
                    recent = deque(known[-most:].tolist())
                else:
                    ok[s:e] = decide(t, recent, micros, most)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ok)], names=["event_id", "user_id", "admitted"])

    timed = _chains(rows.where("at is not null"), micros)
    dealt = timed.select("event_id", "user_id", "at", "__chain").repartition("user_id", "__chain").sortWithinPartitions("user_id", "__chain", "at", "event_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = dealt.mapInArrow(run, f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, admitted boolean")
    return made.unionByName(rows.where("at is null").select("event_id", "user_id", F.lit(False).alias("admitted")))


class Admission(StatefulProcessor):
    """The state of a key: the last admitted times, and what waits for the watermark."""

    def __init__(self, micros: int, most: int):
        self.micros, self.most = micros, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")

    def _timer(self, at: int) -> None:
        # Timers are in milliseconds: the first one that is not before the event.
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = None
        for r in rows:
            if r["at"] is None:
                yield Row(user_id=key[0], event_id=r["event_id"], admitted=False)
                continue
            self.waiting.appendValue((r["at"], r["event_id"]))
            last = r["at"] if last is None else max(last, r["at"])
        if last is not None:
            self._timer(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = list(self.waiting.get())
        due = sorted((r for r in waiting if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        left = [tuple(r) for r in waiting if r[0] > now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        recent = deque(r[0] for r in self.recent.get())
        for r, ok in zip(due, decide([r[0] for r in due], recent, self.micros, self.most), strict=True):
            yield Row(user_id=key[0], event_id=r[1], admitted=ok)
        while recent and recent[0] <= now - self.micros:
            recent.popleft()
        if recent:
            self.recent.put([(t,) for t in recent])
            self._timer(recent[-1] + self.micros)  # then nothing is left of this key
        else:
            self.recent.clear()

    def close(self) -> None:
        pass


def admissions(events: DataFrame, seconds: int = 60, most: int = 10, late: str = "10 seconds") -> DataFrame:
    """(user_id, event_id, admitted) of a stream of events (event_id, user_id, ts), decided once the watermark, ``late`` behind the latest event, has passed them. Needs the RocksDB state store."""
    if seconds < 1 or most < 1:
        raise ValueError("seconds and most are 1 or more")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kind = rows.schema["user_id"].dataType.simpleString()
    return rows.groupBy("user_id").transformWithState(Admission(seconds * 1_000_000, most), f"user_id {kind}, event_id long, admitted boolean", "Append", "EventTime")
