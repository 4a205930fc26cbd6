"""Queries of the monitoring rules: counters that restart, bucket quantiles, caches with a time to live, cooldowns per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import counters as C
from lexforge.plans.base import query
from lexforge.session import table
from lexforge.streaming import state, timers

# Bad share and 95th percentile that raise an alert; the bounds are this table's.
BAD_SHARE, SLOW = 0.05, 150.0
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]

_READINGS = """r AS (SELECT *, count(*) OVER w AS seen, count(*) FILTER (event_type = 'error') OVER w AS bad FROM events
WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS bucket, ts, event_id, seen, bad, lag(seen) OVER s AS s0, lag(bad) OVER s AS b0 FROM r
WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, bucket, sum(CASE WHEN s0 IS NULL THEN 0 WHEN seen >= s0 THEN seen - s0 ELSE seen END) AS seen_up, count(*) FILTER (seen < s0) AS resets,
sum(CASE WHEN b0 IS NULL THEN 0 WHEN bad >= b0 THEN bad - b0 ELSE bad END) AS bad_up, count(*) AS n FROM b GROUP BY user_id, bucket)"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """What a user's counters of requests and of errors read after each event, if they start anew each day."""
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.count(F.lit(1)).over(day).alias("seen"), bad.over(day).alias("bad"))


@query(f"""WITH {_READINGS}
SELECT user_id, bucket, seen_up::DOUBLE AS increase, resets, n, round(sum(seen_up) OVER (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW) / 21600, 9) AS rate FROM g""")
def counter_rates(spark: SparkSession, d: str) -> DataFrame:
    got = C.counter_rates(_readings(spark, d), ["user_id"], "ts", "seen", 3600, 21600, "event_id")
    return got.select("user_id", "bucket", "increase", "resets", "n", F.round("rate", 9).alias("rate"))


@query(f"""WITH {_READINGS}, t AS (SELECT bucket, sum(seen_up)::DOUBLE AS requests, sum(bad_up)::DOUBLE AS errors FROM g GROUP BY bucket)
SELECT bucket, requests, errors, CASE WHEN requests > 0 THEN round(errors / requests, 9) END AS share, coalesce(requests > 0 AND errors / requests > {BAD_SHARE}, false) AS alert FROM t""")
def error_share_alerts(spark: SparkSession, d: str) -> DataFrame:
    readings = _readings(spark, d)
    both = readings.select("user_id", "ts", "event_id", F.explode(F.create_map(F.lit("requests"), "seen", F.lit("errors"), "bad")).alias("what", "v"))
    per = C.increases(both, ["user_id", "what"], "ts", "v", 3600, "event_id")
    up = per.groupBy("bucket").agg(*(F.sum(F.when(F.col("what") == w, F.col("increase")).otherwise(0.0)).alias(w) for w in ("requests", "errors")))
    got = C.share_alerts(up, "errors", "requests", BAD_SHARE)
    return got.select("bucket", "requests", "errors", F.round("share", 9).alias("share"), "alert")


_LE = ", ".join(f"{b}" for b in BOUNDS)


@query(f"""WITH l AS (SELECT i, le, coalesce(lag(le) OVER (ORDER BY i), 0) AS low FROM (SELECT unnest(range(1, {len(BOUNDS) + 2})) AS i, unnest([{_LE}, 'infinity'::DOUBLE]) AS le)),
c AS (SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS bucket, i, le, low, count(*) FILTER (value <= le) AS cum, count(value) AS total, count(*) FILTER (value <= low AND i > 1) AS below FROM events, l GROUP BY ALL),
q AS (SELECT *, unnest([0.5, 0.95, 0.99]) AS quantile FROM c), h AS (SELECT *, row_number() OVER (PARTITION BY event_type, bucket, quantile ORDER BY le) AS r FROM q WHERE cum >= quantile * total)
SELECT event_type, bucket, quantile::DOUBLE AS quantile, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (quantile * total - below) / (cum - below) END, 6) AS value,
CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (quantile * total - below) / (cum - below) END > {SLOW} AS alert FROM h WHERE r = 1""")
def bucket_quantiles(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("bucket", F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))))
    got = C.bucket_quantiles(C.cumulative(events, ["event_type", "bucket"], "value", BOUNDS), ["event_type", "bucket"], [0.5, 0.95, 0.99])
    return got.select("event_type", "bucket", "quantile", F.round("value", 6).alias("value"), (F.col("value") > SLOW).alias("alert"))


def _chain(condition: str, seconds: int) -> str:
    """SQL for the events of a user that each come seconds or more after the one chosen before, from the first on."""
    return f"""e AS (SELECT user_id, epoch_us(ts) AS us, min(event_id) AS event_id FROM events WHERE {condition} GROUP BY user_id, ts),
f AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id UNION ALL
SELECT f.user_id, min(e.us) AS us FROM f JOIN e ON e.user_id = f.user_id AND e.us >= f.us + {seconds * 1_000_000} GROUP BY f.user_id),
chosen AS (SELECT user_id, event_id FROM f JOIN e USING (user_id, us))"""


@query(f"""WITH RECURSIVE {_chain("true", 21600)}
SELECT events.user_id, events.event_id, chosen.event_id IS NULL AS hit FROM events LEFT JOIN chosen USING (event_id)""")
def cache_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Each event looks its user up in a cache that holds a user for six hours from the miss that stored it."""
    got = state.fold(state.keyed(table(spark, d, "events"), "user_id", "event_id", "ts"), timers.TimedCache(21600.0))
    return got.select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "hit")


@query(f"""WITH RECURSIVE {_chain("event_type = 'error' AND value > 50", 86400)}
SELECT user_id, event_id FROM chosen""")
def user_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Slow errors that raise an alert, at most one a day and user."""
    slow = (F.col("event_type") == "error") & (F.col("value") > 50)
    got = state.fold(state.keyed(table(spark, d, "events"), "user_id", "event_id", "ts", slow), state.Cooldown(86400.0))
    return got.where("fired").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"))
