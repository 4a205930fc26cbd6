"""State machines of streaming.state over event time: the same rows from a stream that comes out of order as from a batch.

A row waits in the state of its key until the watermark has passed its time; then the key's rows
are stepped in time order, as fold() steps them. A timer per key says when to look again, and drops
the machine's state once it is older than all it remembers. The state store is RocksDB, which holds
a map entry per waiting time, so a row costs its own entry only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TimedCache:
    """Whether a key is still held: a miss stores it for ttl seconds, which hits do not lengthen."""

    out = "hit boolean"

    def __init__(self, ttl: float) -> None:
        self.ttl = self.memory = ttl

    def start(self) -> dict:
        return {"stored": None}

    def step(self, s: dict, t: float, row) -> tuple:
        hit = s["stored"] is not None and t - s["stored"] < self.ttl
        if not hit:
            s["stored"] = t
        return (hit,)


def timed(df: DataFrame, key: str, id_col: str, ts: str, delay: str, ok: Column | None = None) -> DataFrame:
    """key, id, ts, us and ok, the shape that in_order() reads; rows later than delay are dropped. Rows without a time are left out."""
    at = F.col(ts).cast("timestamp")
    got = df.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), at.alias("ts"), F.unix_micros(at).alias("us"), (F.lit(True) if ok is None else ok).alias("ok"))
    return got.where("us is not null").withWatermark("ts", delay)


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them and steps the machine through them by (time, id)."""

    def __init__(self, machine) -> None:
        self.machine = machine
        self.names = [c.split()[0] for c in machine.out.split(", ")]
        self.memory = getattr(machine, "memory", None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long", "rows string")
        self.held = handle.getValueState("held", "last long, state string")
        self.due = handle.getValueState("due", "ms long")

    def _look_at(self, ms: int) -> None:
        """Moves the key's one timer to ms."""
        if self.due.exists():
            if self.due.get()[0] == ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for us, part in frame.groupby("us"):
                us = int(us)
                new = [[int(r.id), None if r.ok is None else bool(r.ok)] for r in part.itertuples()]
                old = json.loads(self.waiting.getValue((us,))[0]) if self.waiting.containsKey((us,)) else []
                self.waiting.updateValue((us,), (json.dumps(old + new),))
                first = us if first is None else min(first, us)
        if first is not None:
            ms = -(-first // 1000)
            if not self.due.exists() or self.due.get()[0] > ms:
                self._look_at(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        ready, later = [], None
        for (us,), (rows,) in self.waiting.iterator():
            if us <= mark:
                ready.append((us, json.loads(rows)))
            else:
                later = us if later is None else min(later, us)
        last, state = self.held.get() if self.held.exists() else (None, None)
        if ready:
            now = json.loads(state) if state else self.machine.start()
            out = []
            for us, rows in sorted(ready, key=lambda r: r[0]):
                for i, ok in sorted(rows, key=lambda r: r[0]):
                    out.append((key[0], i, us / 1e6, *self.machine.step(now, us / 1e6, SimpleNamespace(ok=ok, id=i))))
                self.waiting.removeKey((us,))
                last = us
            self.held.update((last, json.dumps(now)))
            yield pd.DataFrame(out, columns=["key", "id", "t", *self.names])
        if later is not None:
            self._look_at(-(-later // 1000))
        elif self.memory is not None and last is not None:
            gone = -(-last // 1000) + int(self.memory * 1000) + 1
            if gone * 1000 <= mark:
                self.held.clear()
            else:
                self._look_at(gone)


def in_order(events: DataFrame, machine) -> DataFrame:
    """One row per event of a timed() stream, from the machine run over each key's events in time order.

    Equal to state.fold() over the events that come within the delay, in whatever order and batches
    they come. Rows appear once the watermark has passed them. A machine with memory (seconds after
    which its state equals a new one) has its state dropped then.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=_InOrder(machine), outputStructType=f"key string, id long, t double, {machine.out}", outputMode="Append", timeMode="EventTime")
