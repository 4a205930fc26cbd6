"""Extension points: row functions, named steps, rules, and small time helpers."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, column: str, fn: Callable[[Any], Any], out: str, kind: str) -> DataFrame:
    """df with out = fn(column) in Arrow batches; a row that fails gives null, the others go on."""

    def safe(value: Any) -> Any:
        try:
            return fn(value)
        except Exception:  # noqa: BLE001  whatever the function of the user raises
            return None

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([safe(v) for v in values], index=values.index, dtype=object)

    return df.withColumn(out, run(df[column]))


class Rules:
    """Named Column rules over an original and a corrected text."""

    def __init__(self) -> None:
        self.rules: dict[str, Callable[[Column, Column], Column]] = {}

    def add(self, name: str, rule: Callable[[Column, Column], Column]) -> Rules:
        self.rules[name] = rule
        return self

    def columns(self, original: Column, corrected: Column) -> dict[str, Column]:
        return {n: r(original, corrected) for n, r in self.rules.items()}


class Steps:
    """Named DataFrame steps that depend on one another, run in dependency order with retries."""

    def __init__(self) -> None:
        self.steps: dict[str, tuple[Callable[..., Any], tuple[str, ...], int]] = {}

    def add(self, name: str, fn: Callable[..., Any], after: tuple[str, ...] = (), retries: int = 0) -> Steps:
        self.steps[name] = (fn, tuple(after), retries)
        return self

    def order(self) -> list[str]:
        """Dependency order, by name where it is free; a cycle or an unknown step is an error."""
        done: list[str] = []
        left = dict(self.steps)
        while left:
            ready = sorted(n for n, (_, after, _) in left.items() if all(a in done for a in after))
            if not ready:
                raise ValueError(f"steps that wait for each other or for unknown ones: {sorted(left)}")
            done.append(ready[0])
            del left[ready[0]]
        return done

    def run(self, pause: float = 0.0) -> dict[str, Any]:
        """Results by name; a step gets its predecessors' results."""
        out: dict[str, Any] = {}
        for name in self.order():
            fn, after, retries = self.steps[name]
            for attempt in range(retries + 1):
                try:
                    out[name] = fn(*(out[a] for a in after))
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(pause * 2**attempt)
        return out


class Engines:
    """Reading engines by name: each is a DataFrame function that adds text and confidence to its input."""

    def __init__(self) -> None:
        self.engines: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, read: Callable[[DataFrame], DataFrame]) -> Engines:
        if name in self.engines:
            raise ValueError(f"engine {name!r} is registered already")
        self.engines[name] = read
        return self

    def names(self) -> list[str]:
        return sorted(self.engines)

    def outputs(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The rows of every engine named (all by default), with its name in column engine."""
        frames = [self.engines[n](df).withColumn("engine", F.lit(n)) for n in (names or self.names())]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def learning_rounds(pool: DataFrame, key: str, choose: Callable[[DataFrame], DataFrame], label: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """key, label, round: in every round choose() picks rows of the pool, label() gives them a column
    label, and they leave the pool."""
    from lexforge.session import cut

    known: DataFrame | None = None
    for i in range(rounds):
        fresh = cut(label(choose(pool)).select(key, "label", F.lit(i).alias("round")))
        known = fresh if known is None else known.unionAll(fresh)
        pool = pool.join(fresh.select(key), key, "left_anti")
    if known is None:
        raise ValueError("rounds must be 1 or more")
    return known


def clock(seconds: Column) -> Column:
    """mm:ss of a number of seconds."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def next_run(at: str, now: datetime) -> datetime:
    """The next time of day at (HH:MM) after now."""
    hour, minute = map(int, at.split(":"))
    run = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return run if run > now else run + timedelta(days=1)


def age_days(ts: Column, as_of: Column) -> Column:
    """Days since a time given as ISO text; 999 where it cannot be read."""
    return F.coalesce(F.datediff(as_of, F.try_to_timestamp(ts)), F.lit(999))
