"""Counters that restart and quantiles of cumulative buckets against plain Python."""

import math
import random

from pyspark.sql import functions as F

from lexforge.operators import counters as C

INF = float("inf")


def test_increases_at_random(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        s = rng.choice(["hot", "hot", "hot", "a", None])
        rows.append((s, None if rng.random() < 0.02 else rng.randrange(0, 4000) * 500_000, i, rng.choice([None, math.nan, 0.0, 1.0, 5.0, 5.0, 9.0])))
    df = spark.createDataFrame(rows, "s string, us long, i long, v double").withColumn("ts", F.timestamp_micros("us")).withColumn("bucket", F.lit("clash"))
    got = {(r.s, r.bucket): (r.increase, r.resets, r.n, round(r.rate, 9)) for r in C.counter_rates(df.drop("bucket"), ["s"], "ts", "v", 60, 180, "i").collect()}
    want = {}
    for s in {r[0] for r in rows}:
        last = None
        for us, _, v in sorted((r[1], r[2], r[3]) for r in rows if r[0] == s and r[1] is not None and r[3] is not None and not math.isnan(r[3])):
            b = us // 60_000_000 * 60
            up, falls, n = want.get((s, b), (0.0, 0, 0))
            up += 0 if last is None else v - last if v >= last else v
            want[s, b] = (up, falls + (last is not None and v < last), n + 1)
            last = v
    rate = {(s, b): round(sum(u for (s2, b2), (u, _, _) in want.items() if s2 == s and b - 180 < b2 <= b) / 180, 9) for s, b in want}
    assert got == {k: (*v, rate[k]) for k, v in want.items()}


def plain(buckets, q):
    les = sorted(buckets)
    if not les or les[-1] != INF or len(les) < 2:
        return None
    cum, top = [], 0
    for le in les:
        top = max(top, buckets[le])
        cum.append(top)
    if not top:
        return None
    at = next(i for i, c in enumerate(cum) if c >= q * top)
    if les[at] == INF:
        return les[at - 1]
    low = les[at - 1] if at else min(0.0, les[0])
    below = cum[at - 1] if at else 0
    return low + (les[at] - low) * ((q * top - below) / (cum[at] - below) if cum[at] > below else 1)


def test_bucket_quantiles_at_random(spark):
    rng = random.Random(4)
    groups = {g: {le: rng.randrange(0, 9) for le in rng.sample([-2.0, 0.5, 1.0, 3.0, 10.0], rng.randrange(0, 5)) + [INF] * (rng.random() < 0.9)} for g in range(60)}
    groups[60] = {1.0: 0, INF: 0}
    groups[61] = {INF: 4}
    rows = [(g, le, c) for g, b in groups.items() for le, c in b.items()] + [(0, None, 5), (0, math.nan, 5)]
    got = C.bucket_quantiles(spark.createDataFrame(rows, "g long, le double, count long"), ["g"], [0.0, 0.5, 0.9, 1.0]).collect()
    assert {r.g for r in got} == {g for g, b in groups.items() if b}
    for r in got:
        want = plain(groups[r.g], r.quantile)
        assert (r.value is None) == (want is None), (groups[r.g], r.quantile, r.value, want)
        assert want is None or abs(r.value - want) < 1e-9, (groups[r.g], r.quantile, r.value, want)


def test_empty_tables_and_shares(spark):
    empty = spark.createDataFrame([], "s string, ts timestamp, i long, v double")
    assert C.counter_rates(empty, ["s"], "ts", "v", 60, 180, "i").count() == 0
    assert C.bucket_quantiles(C.cumulative(empty, ["s"], "v", [1.0]), ["s"], [0.5]).count() == 0
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 10.0), (0.0, 0.0)], "bad double, n double")
    assert [(r.share, r.alert) for r in C.share_alerts(df, "bad", "n", 0.1).collect()] == [(0.1, False), (0.2, True), (None, False)]
    values = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", None), ("a", 7.0), ("b", None)], "s string, v double")
    got = {(r.s, r.le): r["count"] for r in C.cumulative(values, ["s"], "v", [5.0, 1.0]).collect()}
    assert got == {("a", 1.0): 1, ("a", 5.0): 1, ("a", INF): 3, ("b", 1.0): 0, ("b", 5.0): 0, ("b", INF): 0}
