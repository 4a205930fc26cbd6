"""Windowed metrics that read alike on batch and streaming frames, and stream plumbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """ts as a TIMESTAMP, which watermarks need; watermark such as '10 minutes' bounds lateness."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark) if watermark else df


def buckets(df: DataFrame, width: str, value: str, ts: str = "ts", by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """avg, n, min and max of value per time bucket (tumbling, or sliding with slide)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    got = df.groupBy(w.alias("w"), *(by or [])).agg(F.avg(value).alias("avg"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return got.select(F.unix_timestamp("w.start").alias("bucket"), *(by or []), "avg", "n", "min", "max")


def sessions(df: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """Sessions of each key that end after gap without events.

    Ends are aggregates, not the window's own: Spark moves a filter on the window below the merging of
    sessions, where it drops events instead of sessions.
    """
    # windows that touch are merged, so they are a microsecond short: a gap of just that length ends a session
    short = f"{gap} -1 microseconds"
    ends = F.min(ts).alias("first"), F.max(F.col(ts) + F.expr(f"interval {gap}")).alias("last")
    got = df.groupBy(F.session_window(ts, short).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), *ends)
    return got.select(key, F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"), "n")


def settled(df: DataFrame, key: str, gap: str, as_of: Column, ts: str = "ts") -> DataFrame:
    """Debounce: sessions whose quiet period is over at as_of (microseconds)."""
    return sessions(df, key, gap, ts).where(F.col("end_us") <= as_of)


def error_ratio(df: DataFrame, bad: Column, width: str, slide: str, limit: float, ts: str = "ts") -> DataFrame:
    """Sliding share of bad events, and whether it is over limit."""
    got = df.groupBy(F.window(ts, width, slide).alias("w")).agg((F.count_if(bad) / F.count(F.lit(1))).alias("ratio"), F.count(F.lit(1)).alias("n"))
    return got.select(F.unix_timestamp("w.start").alias("bucket"), "ratio", "n", (F.col("ratio") > limit).alias("alert"))


def threshold_alerts(df: DataFrame, value: str, width: str, above: float, spike: float, ts: str = "ts") -> DataFrame:
    """Buckets whose mean is over above, or over spike times the bucket's own 95th percentile."""
    v = F.col(value).cast("double")
    got = df.groupBy(F.window(ts, width).alias("w")).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.95)).alias("p95"))
    return got.select(F.unix_timestamp("w.start").alias("bucket"), "mean", (F.col("mean") > above).alias("above"), (F.col("mean") > F.col("p95") * spike).alias("spike"))


def deduplicated(df: DataFrame, keys: list[str], watermark: str, ts: str = "ts") -> DataFrame:
    """Stream without repeats of keys within the watermark."""
    return event_time(df, ts, watermark).dropDuplicatesWithinWatermark(keys)


def watch_folder(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; the checkpoint remembers what was seen."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(path)


def fan_out(events: DataFrame, subscribers: DataFrame, tenant: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Every event with each subscriber of its tenant whose heartbeat (column seen) is at most seconds
    older than the event; subscribers hold tenant, subscriber and seen."""
    alive = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))
    return events.join(subscribers, tenant).where(alive.between(0, seconds * 1_000_000)).drop("seen")


def upsert_stream(df: DataFrame, apply, checkpoint: str, trigger: dict | None = None):
    """Starts a query that hands every micro-batch to apply(frame, batch_id)."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retrain_trigger(least: int, train):
    """foreachBatch function that calls train(frame) for batches of least rows or more."""

    def apply(frame: DataFrame, batch: int) -> None:
        if frame.limit(least).count() >= least:
            train(frame)

    return apply
