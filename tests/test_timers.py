"""Event-time machines: a replayed file stream that comes out of order gives the rows of the batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexforge.streaming import state, timers

SCHEMA = "id long, k string, ts timestamp, ok boolean"
START = 1_704_067_200


def replay(spark, folder, batches, machine, delay="60 seconds"):
    """The stream's rows after one batch per file, closed by a row of another key that lifts the watermark."""
    last = max(r["s"] for b in batches for r in b)
    closing = [[{"id": -1, "k": "end", "s": last + 100_000, "ok": False}], [{"id": -2, "k": "end", "s": last + 100_001, "ok": False}]]
    source = folder / "in"
    source.mkdir()
    for i, batch in enumerate(batches + closing):
        lines = [json.dumps({"id": r["id"], "k": r["k"], "ok": r["ok"], "ts": f"{spark_time(r['s'])}"}) for r in batch]
        path = source / f"{i:04d}.json"
        path.write_text("\n".join(lines))
        import os

        os.utime(path, (START + i * 10, START + i * 10))
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    out = timers.in_order(timers.timed(events, "k", "id", "ts", delay, F.col("ok")), machine)
    running = out.writeStream.format("parquet").option("checkpointLocation", str(folder / "check")).option("path", str(folder / "out")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert not running.isActive
    rows = spark.read.parquet(str(folder / "out")).where("key <> 'end'").collect()
    return sorted(tuple(r[c] for c in ("key", "id", *[x.split()[0] for x in machine.out.split(", ")])) for r in rows)


def spark_time(s):
    import datetime

    return datetime.datetime.fromtimestamp(START + s, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def batch(spark, events, machine):
    df = spark.createDataFrame([(r["id"], r["k"], float(START + r["s"]), r["ok"]) for r in events], "id long, k string, s double, ok boolean")
    got = state.fold(state.keyed(df.withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))), "k", "id", "ts", F.col("ok")), machine).collect()
    return sorted(tuple(r[c] for c in ("key", "id", *[x.split()[0] for x in machine.out.split(", ")])) for r in got)


@pytest.mark.parametrize("machine", [timers.TimedCache(25.0), state.Cooldown(20.0), state.CircuitBreaker(2, 15.0, 2, 1)], ids=["cache", "cooldown", "breaker"])
def test_stream_out_of_order_equals_batch(spark, tmp_path, machine):
    rng = random.Random(5)
    events = [{"id": i, "k": rng.choice("abc"), "s": i * 4 + rng.choice([0, 0.5, 0.25]), "ok": rng.random() < 0.6} for i in range(60)]
    events.append({**events[30], "id": 500})  # two rows of one time
    late = sorted(events, key=lambda r: r["s"] + rng.uniform(0, 50))  # at most 50 seconds late
    got = replay(spark, tmp_path, [late[i : i + 12] for i in range(0, len(late), 12)], machine)
    assert got == batch(spark, events, machine)


def test_rows_beyond_the_delay_are_dropped_and_state_is_gone(spark, tmp_path):
    one = [{"id": 0, "k": "a", "s": 0, "ok": True}]
    far = [{"id": 1, "k": "b", "s": 500, "ok": True}]
    late = [{"id": 2, "k": "a", "s": 1, "ok": True}, {"id": 3, "k": "a", "s": 480, "ok": True}]
    got = replay(spark, tmp_path, [one, far, far[:0] or [{"id": 4, "k": "b", "s": 505, "ok": True}], late], timers.TimedCache(10.0))
    assert got == [("a", 0, False), ("a", 3, False), ("b", 1, False), ("b", 4, True)]
