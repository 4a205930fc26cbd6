"""Votes, rates, summaries, health scores and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority_vote(df: DataFrame, key: str, value: str, least: int = 1, order: str | None = None) -> DataFrame:
    """key, winner, votes: the most frequent value of each key, ties to the smallest value."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(key).agg(F.min_by(F.struct(value, "votes"), F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v"))).alias("w"))
    return best.select(key, F.col(f"w.{value}").alias("winner"), F.col("w.votes").alias("votes")).where(F.col("votes") >= least)


def vote_with_provenance(df: DataFrame, key: str, value: str, ts: str, context: str, least: int = 1) -> DataFrame:
    """majority_vote with first_seen and the sorted distinct contexts of all entries of the key."""
    seen = df.groupBy(key).agg(F.min(ts).alias("first_seen"), F.array_sort(F.collect_set(context)).alias("contexts"))
    return majority_vote(df, key, value, least).join(seen, key)


def summary(value: str, ts: str) -> list[Column]:
    """n, mean, sample deviation (0 under two values), extremes, interpolated percentiles and the last value."""
    v = F.col(value).cast("double")
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        p[0].alias("p50"), p[1].alias("p95"), p[2].alias("p99"), F.max_by(v, F.col(ts)).alias("last"),
    ]


def calibrated(confidence: str, usage: str) -> list[Column]:
    """Threshold suggestions: quartiles of confidence, upper percentiles of usage, and the deviation variant."""
    c, u = F.col(confidence).cast("double"), F.col(usage).cast("double")
    return [
        F.percentile(c, F.lit(0.25)).alias("conf_p25"), F.percentile(c, F.lit(0.5)).alias("conf_p50"), F.percentile(u, F.lit(0.75)).alias("use_p75"), F.percentile(u, F.lit(0.9)).alias("use_p90"),
        (F.avg(c) - F.stddev_pop(c)).alias("conf_low"), F.avg(c).alias("conf_mean"),
    ]


def rate(condition: Column) -> Column:
    """Share of rows in percent; null where there are no rows."""
    return F.count_if(condition) * 100.0 / F.count(F.lit(1))


def counters(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n for each dimension, in one grouping-sets pass."""
    grouped = df.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    top = len(dimensions) - 1
    full = (1 << len(dimensions)) - 1
    name = F.coalesce(*[F.when(F.col("g") == full - (1 << (top - i)), F.lit(d)) for i, d in enumerate(dimensions)])
    value = F.coalesce(*[F.when(F.col("g") == full - (1 << (top - i)), F.col(d).cast("string")) for i, d in enumerate(dimensions)])
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def histogram_over(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of a fixed list of values, zeros included."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.where(df[column].isin(values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def provider_health(df: DataFrame, provider: str, ts: str, latency: str, ok: Column, as_of: Column, window: int = 100) -> DataFrame:
    """Health of each provider over its last window requests.

    success is weighted by exp(-age/60), latency enters as exp(-mean/10000), recency as exp(-age/120)
    of the newest request; a running streak of failures costs a tenth each, half at most.
    """
    order = Window.partitionBy(provider).orderBy(F.desc(ts), F.desc("__tie"))
    rows = df.withColumn("__tie", F.xxhash64(*df.columns)).withColumn("ok", ok).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= window)
    rows = rows.withColumn("age", as_of - F.unix_timestamp(F.col(ts).cast("timestamp")))
    w = F.exp(-F.col("age") / 60.0)
    got = rows.groupBy(provider).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("ok").cast("double")).alias("success_rate"),
        F.avg(latency).alias("avg_latency"),
        F.percentile(F.col(latency).cast("double"), F.lit(0.95)).alias("p95_latency"),
        F.count_if(~F.col("ok")).alias("errors"),
        (F.sum(w * F.col("ok").cast("double")) / F.sum(w)).alias("weighted"),
        F.min("age").alias("newest"),
        (F.coalesce(F.min(F.when(F.col("ok"), F.col("rn"))), F.max("rn") + 1) - 1).alias("streak"),
    )
    raw = 0.5 * F.coalesce("weighted", "success_rate") + 0.3 * F.exp(-F.col("avg_latency") / 10000.0) + 0.2 * F.exp(-F.col("newest") / 120.0)
    return got.withColumn("score", F.greatest(F.lit(0.0), raw - F.least(0.1 * F.col("streak"), F.lit(0.5))))


def running_average(values: Column) -> Column:
    """Pairwise running average (a+b)/2 in array order, which weights late values most."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda a, b: (a + b) / 2)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with lo_c and hi_c for each column."""
    return df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])


def worst_level(levels: Column, order: list[str]) -> Column:
    """The highest of an array of named levels, the first of order if it is empty."""
    rank = F.array_max(F.transform(levels, lambda x: F.array_position(F.lit(order), x)))
    return F.element_at(F.lit(order), F.greatest(F.coalesce(rank, F.lit(1)), F.lit(1)).cast("int"))


def verified_chain(df: DataFrame, key: str, order: str, fields: list[str], previous: str, entry: str) -> DataFrame:
    """key, n, broken, first_break of a ledger whose rows hold the hash of the row before and their own.

    An entry must be the SHA-256 of its previous hash and its fields; its previous hash must be the
    entry of the row before it, null or empty for the first. Every row is checked by itself and its
    neighbour, so a long chain is no sequential work.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.lag(entry).over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    own = F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), *(F.col(f).cast("string") for f in fields)), 256)
    bad = (own != F.col(entry)) | (F.coalesce(previous, F.lit("")) != before)
    rows = df.select(key, order, bad.alias("bad"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("broken"), F.min(F.when(F.col("bad"), F.col(order))).alias("first_break"))
