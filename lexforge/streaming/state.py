"""Stateful event logic as folds over one key's events in time order.

Each machine is a plain class with a dict state, so the same code serves a batch (one key's ordered
events in applyInPandas) and a stream (applyInPandasWithState keeps the dict between batches).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Requests a minute and burst of each tier.
TIERS = {"free": (10, 2), "standard": (100, 10), "premium": (500, 50), "enterprise": (2000, 200), "unlimited": (999999, 0)}


class RateLimiter:
    """Sliding-window limit with burst; enough violations within an hour lock the key for a while."""

    out = "allowed boolean, in_window long, penalised boolean"

    def __init__(self, limit: int = 10, burst: int = 2, window: float = 60.0, violations: int = 5, penalty: float = 300.0) -> None:
        self.limit, self.burst, self.window, self.violations, self.penalty = limit, burst, window, violations, penalty

    def start(self) -> dict:
        return {"hits": [], "from": 0, "bad": [], "until": 0.0}

    def step(self, s: dict, t: float, row) -> tuple:
        if t < s["until"]:
            return False, len(s["hits"]) - s["from"], True
        hits = s["hits"]
        while s["from"] < len(hits) and hits[s["from"]] <= t - self.window:
            s["from"] += 1
        if s["from"] > len(hits) // 2:  # what has left the window goes when it is the larger part
            del hits[: s["from"]]
            s["from"] = 0
        n = len(hits) - s["from"]
        allowed = n < self.limit + self.burst
        if allowed:
            hits.append(t)
        else:
            s["bad"] = [b for b in s["bad"] if b > t - 3600] + [t]
            if len(s["bad"]) >= self.violations:
                s["until"], s["bad"] = t + self.penalty, []
        return allowed, n + allowed, False


class CircuitBreaker:
    """closed -> open after failures in a row; half-open after a pause; closed after successes in it."""

    out = "state string, passed boolean"

    def __init__(self, failures: int = 5, recovery: float = 30.0, trials: int = 3, successes: int = 2) -> None:
        self.failures, self.recovery, self.trials, self.successes = failures, recovery, trials, successes

    def start(self) -> dict:
        return {"state": "closed", "bad": 0, "good": 0, "since": 0.0, "trials": 0}

    def step(self, s: dict, t: float, row) -> tuple:
        if s["state"] == "open" and t - s["since"] >= self.recovery:
            s |= {"state": "half_open", "good": 0, "trials": 0}
        if s["state"] == "open" or (s["state"] == "half_open" and s["trials"] >= self.trials):
            return s["state"], False
        if s["state"] == "half_open":
            s["trials"] += 1
        if row.ok:
            s["good"] += 1
            s["bad"] = 0
            if s["state"] == "half_open" and s["good"] >= self.successes:
                s |= {"state": "closed", "bad": 0}
        else:
            s["bad"] += 1
            if s["state"] == "half_open" or s["bad"] >= self.failures:
                s |= {"state": "open", "since": t, "good": 0}
        return s["state"], True


class Throttle:
    """Blocks a provider after a call that failed, twice as long with every failure in a row, and
    while its quota of calls in the window is used up; a good call ends the row."""

    out = "sent boolean, wait double"

    def __init__(self, quota: int = 60, window: float = 60.0, pause: float = 1.0, longest: float = 300.0) -> None:
        self.quota, self.window, self.pause, self.longest = quota, window, pause, longest

    def start(self) -> dict:
        return {"until": 0.0, "failures": 0, "since": 0.0, "used": 0}

    def step(self, s: dict, t: float, row) -> tuple:
        if t < s["until"]:
            return False, s["until"] - t
        if t - s["since"] >= self.window:
            s |= {"since": t, "used": 0}
        if s["used"] >= self.quota:
            s["until"] = s["since"] + self.window
            return False, s["until"] - t
        s["used"] += 1
        if row.ok:
            s["failures"] = 0
        else:
            s["until"] = t + min(self.pause * 2 ** s["failures"], self.longest)
            s["failures"] += 1
        return True, 0.0


class Cooldown:
    """Passes a firing event only if none of its key passed within the last seconds."""

    out = "fired boolean"

    def __init__(self, seconds: float = 300.0) -> None:
        self.seconds = self.memory = seconds

    def start(self) -> dict:
        return {"last": None}

    def step(self, s: dict, t: float, row) -> tuple:
        fire = bool(row.ok) and (s["last"] is None or t - s["last"] >= self.seconds)
        if fire:
            s["last"] = t
        return (fire,)


def _run(machine, state: dict, frame: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in machine.out.split(", ")]
    rows = [machine.step(state, row.t, row) for row in frame.itertuples(index=False)]
    return pd.concat([frame[["key", "id", "t"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)


def keyed(df: DataFrame, key: str, id_col: str, ts: str, ok=None) -> DataFrame:
    """key, id, t (seconds) and ok, the shape that the machines read."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), seconds.alias("t"), (F.lit(True) if ok is None else ok).alias("ok"))


def fold(events: DataFrame, machine) -> DataFrame:
    """One row per event, from the machine run over each key's events in time order.

    The sequence of one key is what the state depends on, so a key is one group; its rows are
    read in Arrow batches in order, and only the state is held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            out = []
            for key, part in frame.groupby("key", sort=False):
                if key != current:
                    current, state = key, machine.start()
                out.append(_run(machine, state, part))
            if out:
                yield pd.concat(out, ignore_index=True)

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartition(parts, "key").sortWithinPartitions("key", "t", "id")
    return dealt.mapInPandas(run, f"key string, id long, t double, {machine.out}")


def stream(events: DataFrame, machine, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The same over a stream of keyed() events; state is dropped after idle_ms without events.

    A processing-time timeout keeps a query running batch after batch, so give None for a query
    that is to end by itself (trigger availableNow).
    """

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else machine.start()
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["t", "id"])
        out = _run(machine, held, frame)
        state.update((json.dumps(held),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    return events.groupBy("key").applyInPandasWithState(step, f"key string, id long, t double, {machine.out}", "s string", "append", timeout)
