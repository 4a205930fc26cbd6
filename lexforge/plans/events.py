"""Queries over the event stream: votes, audit counts, health, windows and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import aggregates as A
from lexforge.plans.base import query
from lexforge.session import table
from lexforge.streaming import state, windows


def _events(spark: SparkSession, d: str) -> DataFrame:
    return windows.event_time(table(spark, d, "events"))


@query("""SELECT user_id, event_type AS winner, n AS votes FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE r = 1 AND n >= 2""")
def correction_vote(spark: SparkSession, d: str) -> DataFrame:
    return A.majority_vote(table(spark, d, "events"), "user_id", "event_type", 2)


@query("""WITH v AS (SELECT user_id, event_type AS winner, n AS votes FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE r = 1)
SELECT user_id, winner, votes, epoch_us(first_seen) AS first_us, contexts FROM v JOIN (
SELECT user_id, min(ts) AS first_seen, string_agg(DISTINCT props, '|' ORDER BY props) AS contexts FROM events GROUP BY user_id) USING (user_id)""")
def correction_provenance(spark: SparkSession, d: str) -> DataFrame:
    got = A.vote_with_provenance(_events(spark, d), "user_id", "event_type", "ts", "props")
    return got.select("user_id", "winner", "votes", F.unix_micros("first_seen").alias("first_us"), F.array_join("contexts", "|").alias("contexts"))


@query("""SELECT user_id, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS error_rate,
round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 6) AS purchase_rate, count(*) AS n FROM events GROUP BY user_id""")
def audit_rates(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(A.rate(e == "error"), 6).alias("error_rate"), F.round(A.rate(e == "purchase"), 6).alias("purchase_rate"), F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN g = 1 THEN 'event_type' ELSE 'user_id' END AS dimension, CASE WHEN g = 1 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS value, n FROM (
SELECT event_type, user_id, count(*) AS n, GROUPING(event_type, user_id) AS g FROM events GROUP BY GROUPING SETS ((event_type), (user_id)))""")
def multi_dim_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.counters(table(spark, d, "events"), ["event_type", "user_id"])


@query("""SELECT r AS event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'error', 'noise', 'too_short', 'view']) AS r)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) ON event_type = r""")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram_over(table(spark, d, "events"), "event_type", ["click", "error", "noise", "too_short", "view"])


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, arg_max(value, ts) AS last FROM events GROUP BY event_type""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").groupBy("event_type").agg(*A.summary("value", "ts"))
    return got.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", "max", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "last")


@query("""WITH u AS (SELECT user_id, avg(value) AS c, count(*)::DOUBLE AS n FROM events GROUP BY user_id)
SELECT round(quantile_cont(c, 0.25), 6) AS conf_p25, round(quantile_cont(c, 0.5), 6) AS conf_p50, round(quantile_cont(n, 0.75), 6) AS use_p75, round(quantile_cont(n, 0.9), 6) AS use_p90,
round(avg(c) - stddev_pop(c), 6) AS conf_low, round(avg(c), 6) AS conf_mean FROM u""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("c"), F.count(F.lit(1)).alias("n"))
    got = per.agg(*A.calibrated("c", "n"))
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query("""WITH m AS (SELECT epoch(date_trunc('second', max(ts)))::BIGINT AS t FROM events),
r AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, count(*) AS n, round(avg(ok::INT), 6) AS success_rate, round(avg(value), 6) AS avg_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency,
count(*) FILTER (NOT ok) AS errors, coalesce(min(CASE WHEN ok THEN rn END), max(rn) + 1) - 1 AS streak,
min(t - epoch(date_trunc('second', ts))::BIGINT) AS newest FROM r, m WHERE rn <= 100 GROUP BY user_id""")
def provider_health(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    last = events.agg(F.unix_timestamp(F.max("ts")).alias("t"))  # one row
    rows = events.join(F.broadcast(last))
    got = A.provider_health(rows, "user_id", "ts", "value", F.col("event_type") != "error", F.col("t"))
    return got.select("user_id", "n", *(F.round(c, 6).alias(c) for c in ("success_rate", "avg_latency", "p95_latency")), "errors", F.col("streak").cast("long").alias("streak"), "newest")


@query("""SELECT (epoch(date_trunc('second', ts))::BIGINT // 3600) * 3600 AS bucket, round(avg(value), 6) AS avg, count(value) AS n, min(value) AS min, max(value) AS max FROM events GROUP BY 1""")
def tumbling_buckets(spark: SparkSession, d: str) -> DataFrame:
    return windows.buckets(_events(spark, d), "1 hour", "value").withColumn("avg", F.round("avg", 6))


@query("""SELECT b * 3600 AS bucket, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) > 0.25 AS alert FROM (
SELECT event_type, unnest(range(epoch(date_trunc('second', ts))::BIGINT // 3600 - 2, epoch(date_trunc('second', ts))::BIGINT // 3600 + 1)) AS b FROM events) GROUP BY b""")
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    return windows.error_ratio(_events(spark, d), F.col("event_type") == "error", "3 hours", "1 hour", 0.25).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM (
SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s""")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(_events(spark, d), "user_id", "30 minutes")


@query("""SELECT event_id, user_id, in_window, in_window <= 2 AS allowed FROM (
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS in_window FROM events)""")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-21599, 0)
    return _events(spark, d).withColumn("in_window", F.count(F.lit(1)).over(w)).select("event_id", "user_id", "in_window", (F.col("in_window") <= 2).alias("allowed"))


@query()
def rate_limiter_fold(spark: SparkSession, d: str) -> DataFrame:
    events = state.keyed(table(spark, d, "events"), "user_id", "event_id", "ts")
    return state.fold(events, state.RateLimiter(limit=1, burst=1, window=21600.0, violations=3, penalty=7200.0))


@query()
def breaker_fsm(spark: SparkSession, d: str) -> DataFrame:
    events = state.keyed(table(spark, d, "events"), "user_id", "event_id", "ts", F.col("event_type") != "error")
    return state.fold(events, state.CircuitBreaker(failures=2, recovery=3600.0))


@query("""SELECT (epoch(date_trunc('second', ts))::BIGINT // 3600) * 3600 AS bucket, round(avg(value), 6) AS mean, round(avg(value), 6) > 25 AS above,
avg(value) > quantile_cont(value, 0.95) * 0.5 AS spike FROM events GROUP BY 1""")
def threshold_alerts(spark: SparkSession, d: str) -> DataFrame:
    got = windows.threshold_alerts(_events(spark, d), "value", "1 hour", 25.0, 0.5)
    return got.select("bucket", F.round("mean", 6).alias("mean"), (F.round("mean", 6) > 25).alias("above"), "spike")


@query()
def alerts_cooldown(spark: SparkSession, d: str) -> DataFrame:
    alerts = threshold_alerts(spark, d).select(F.lit("value").alias("key"), F.col("bucket").alias("id"), F.timestamp_seconds("bucket").alias("ts"), F.col("above").alias("hit"))
    return state.fold(state.keyed(alerts, "key", "id", "ts", F.col("hit")), state.Cooldown(7200.0))


@query("""SELECT event_id, user_id, event_type FROM (
SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap > 86400000000""")
def ttl_dedup(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    return _events(spark, d).withColumn("gap", gap).where("gap is null or gap > 86400000000").select("event_id", "user_id", "event_type")


@query("""SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS keys, round(1 - count(DISTINCT user_id) / count(*), 6) AS hit_rate FROM events GROUP BY event_type""")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("keys"))
    return got.withColumn("hit_rate", F.round(1 - F.col("keys") / F.col("requests"), 6))


@query("""WITH c AS (SELECT event_id // 16 AS ledger, list(event_id || '|' || event_type ORDER BY event_id) AS items, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1),
e AS (SELECT ledger, ids[i] AS event_id, items[i] AS item, list_reduce(list_concat([''], items[1:i - 1]), lambda a, x: sha256(a || '|' || x)) AS p, list_reduce(list_concat([''], items[1:i]), lambda a, x: sha256(a || '|' || x)) AS entry FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM c)),
l AS (SELECT ledger, event_id, CASE WHEN event_id % 101 = 0 THEN event_id || '|forged' ELSE item END AS item, CASE WHEN event_id % 103 = 0 THEN 'cut' ELSE p END AS p, entry FROM e WHERE event_id % 211 <> 5),
b AS (SELECT ledger, event_id, sha256(p || '|' || item) <> entry OR p <> coalesce(lag(entry) OVER (PARTITION BY ledger ORDER BY event_id), '') AS bad FROM l)
SELECT ledger, count(*) AS n, count(*) FILTER (bad) AS broken, min(event_id) FILTER (bad) AS first_break FROM b GROUP BY ledger""")
def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ledgers of 16 events each, some rows of which are forged, cut off or missing, are checked from their own columns."""
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 16).alias("ledger"), "event_id", "event_type")
    listed = rows.groupBy("ledger").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("items"))  # 16 at most
    entry = lambda p, x: F.sha2(F.concat_ws("|", p, x.event_id.cast("string"), x.event_type), 256)
    start = F.array().cast("array<string>")
    hashes = F.aggregate("items", start, lambda acc, x: F.concat(acc, F.array(entry(F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(""), x))))
    each = listed.withColumn("hashes", hashes).select("ledger", "hashes", F.posexplode("items").alias("i", "x"))
    before = F.when(F.col("i") > 0, F.get("hashes", F.col("i") - 1)).otherwise("")
    each = each.select("ledger", "x.event_id", "x.event_type", before.alias("p"), F.get("hashes", F.col("i")).alias("entry_hash")).where("event_id % 211 <> 5")
    forged = F.when(F.col("event_id") % 101 == 0, "forged").otherwise(F.col("event_type"))
    cut = F.when(F.col("event_id") % 103 == 0, "cut").otherwise(F.col("p"))
    ledger = each.select("ledger", "event_id", forged.alias("event_type"), cut.alias("prev_hash"), "entry_hash")
    return A.verified_chain(ledger, "ledger", "event_id", ["event_id", "event_type"], "prev_hash", "entry_hash")


@query("""SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id""")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("event_id"))


@query("""SELECT user_id, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS improvement FROM events GROUP BY user_id""")
def improvement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.max_by("value", "event_id") - F.min_by("value", "event_id"), 6).alias("improvement"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type FROM events WHERE json_extract_string(props, '$.k')::BIGINT = 7""")
def label_match(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.relational import map_contains

    rows = table(spark, d, "events").withColumn("labels", F.from_json("props", "map<string,string>"))
    return rows.where(map_contains(F.col("labels"), {"k": "7"})).select("event_id", F.col("labels")["k"].cast("long").alias("k"), "event_type")


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' AND event_type <> 'view' GROUP BY ALL""")
def user_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-02' and ts < timestamp_ntz'2024-01-09' and event_type <> 'view'")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT max(ts) AS t FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(date_diff('day', ts::DATE, t::DATE))::INT AS age_days FROM events, m WHERE ts >= t - INTERVAL 24 HOUR GROUP BY event_type""")
def recent_summary(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    rows = events.join(F.broadcast(events.agg(F.max("ts").alias("t")))).where(F.col("ts") >= F.col("t") - F.expr("interval 24 hours"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min(F.datediff("t", "ts")).alias("age_days"))
