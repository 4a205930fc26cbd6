"""Rates of counters that restart, and quantiles read from cumulative buckets.

A series may hold any share of the rows: readings meet only inside their time bucket, and what goes
on by series is one row per bucket, so its number follows the time covered and not the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def increases(df: DataFrame, series: list[str], ts: str, value: str, seconds: int, tie: str) -> DataFrame:
    """series, bucket (its first second), increase, resets and n of every bucket that holds a reading.

    Between two readings a counter grew by their difference; a fall is a restart, after which it grew
    from nothing to the new reading. Growth belongs to the bucket of the later reading; the first one of
    a series shows none. Readings of one time go by tie, a number. Null and NaN readings, and rows without
    a time, are left out; null names of series are a series. Empty tables give no rows.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    fine = df.select(*series, us.alias("us"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("v")).where("us is not null and v is not null and not isnan(v)")
    rows = fine.withColumn("bucket", F.floor(F.col("us") / F.lit(1_000_000) / seconds).cast("long") * seconds)
    before = F.lag("v").over(Window.partitionBy(*series, "bucket").orderBy("us", "tie"))
    grown = F.when(F.col("v") >= F.col("before"), F.col("v") - F.col("before")).when(F.col("before").isNotNull(), F.col("v"))
    at = F.struct("us", "tie")
    per = rows.withColumn("before", before).groupBy(*series, "bucket").agg(
        F.coalesce(F.sum(grown), F.lit(0.0)).alias("inner"), F.count_if(F.col("v") < F.col("before")).alias("falls"),
        F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last"), F.count(F.lit(1)).alias("n"))
    step = Window.partitionBy(*series).orderBy("bucket")
    per = per.withColumn("came", F.lag("last").over(step))
    entry = F.when(F.col("came").isNull(), 0.0).when(F.col("first") >= F.col("came"), F.col("first") - F.col("came")).otherwise(F.col("first"))
    return per.select(*series, "bucket", (F.col("inner") + entry).alias("increase"), (F.col("falls") + F.coalesce((F.col("first") < F.col("came")).cast("long"), F.lit(0))).alias("resets"), "n")


def counter_rates(df: DataFrame, series: list[str], ts: str, value: str, seconds: int, span: int, tie: str) -> DataFrame:
    """increases() with rate: growth a second over the span seconds that end with the bucket.

    Nothing is extrapolated; a span that begins before the series counts as whole.
    """
    per = increases(df, series, ts, value, seconds, tie)
    over = Window.partitionBy(*series).orderBy("bucket").rangeBetween(seconds - span, 0)
    return per.withColumn("rate", F.sum("increase").over(over) / span)


def share_alerts(rates: DataFrame, part: str, whole: str, limit: float) -> DataFrame:
    """Rows of rates with share, column part over column whole (null where whole is 0), and whether it is over limit."""
    got = rates.withColumn("share", F.when(F.col(whole) > 0, F.col(part) / F.col(whole)))
    return got.withColumn("alert", F.coalesce(F.col("share") > limit, F.lit(False)))


def cumulative(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """by, le and count: how many values are at most le, for every bound and for infinity, which holds NaN too; nulls count nowhere."""
    v = F.col(value).cast("double")
    counts = [F.count_if((v <= b) & ~F.isnan(v)) for b in sorted(bounds)] + [F.count(v)]
    got = df.groupBy(*by).agg(F.array(*counts).alias("counts"))
    les = F.array(*(F.lit(float(b)) for b in [*sorted(bounds), float("inf")]))
    return got.select(*by, F.explode(F.arrays_zip(les.alias("le"), F.col("counts").alias("count"))).alias("b")).select(*by, "b.le", "b.count")


def bucket_quantiles(df: DataFrame, by: list[str], quantiles: list[float], le: str = "le", count: str = "count") -> DataFrame:
    """by, quantile and value: each quantile interpolated inside the first cumulative bucket that reaches its rank.

    The lowest bucket begins at 0 if its bound is above 0, else at its bound. A rank in the bucket of
    infinity gives the highest finite bound. Counts that fall from one bound to the next are held at the
    larger one; repeated bounds are summed. Groups without counts, without a bucket of infinity or with
    that bucket alone give null.
    """
    rows = df.where(F.col(le).isNotNull() & ~F.isnan(le)).groupBy(*by, F.col(le).cast("double").alias("le")).agg(F.sum(F.coalesce(F.col(count), F.lit(0))).cast("double").alias("count"))
    up = Window.partitionBy(*by).orderBy("le")
    every = Window.partitionBy(*by)
    rows = rows.withColumn("cum", F.max("count").over(up)).withColumn("low", F.lag("le").over(up)).withColumn("below", F.coalesce(F.lag("cum").over(up), F.lit(0.0)))
    rows = rows.withColumn("total", F.max("cum").over(every)).withColumn("top", F.max("le").over(every))
    rows = rows.withColumn("quantile", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    rank = F.col("quantile") * F.col("total")
    whole = (F.col("total") > 0) & (F.col("top") == float("inf"))
    first = F.coalesce("low", F.least(F.col("le"), F.lit(0.0)))
    inside = first + (F.col("le") - first) * F.when(F.col("cum") > F.col("below"), (rank - F.col("below")) / (F.col("cum") - F.col("below"))).otherwise(1.0)
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    reached = whole & (F.col("cum") >= rank)
    return rows.groupBy(*by, "quantile").agg(F.min_by(F.when(reached, F.struct(value.alias("value"))), F.when(reached, F.col("le"))).alias("got")).select(*by, "quantile", F.col("got.value").alias("value"))
