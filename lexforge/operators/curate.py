"""Validation, triage, promotion, memory, splits and samples of training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.normalize import ARABIC
from lexforge.session import cut


def validated(original: Column, corrected: Column, lang: Column | None = None, rules: dict[str, Column] | None = None) -> Column:
    """struct<checks,score,is_valid>: non-empty, changed, length ratio 0.3 to 3, no control characters,
    a tenth of Arabic letters where lang is ar, and custom rules, each of which costs a tenth."""
    ratio = F.char_length(corrected) / F.greatest(F.char_length(original), F.lit(1))
    checks = {
        "non_empty": (F.trim(original) != "") & (F.trim(corrected) != ""), "changed": original != corrected, "length_ratio": ratio.between(0.3, 3.0),
        "printable": ~corrected.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
    }
    if lang is not None:
        share = F.regexp_count(corrected, F.lit(ARABIC)) / F.greatest(F.char_length(corrected), F.lit(1))
        checks["script"] = (lang != "ar") | (share > 0.1)
    score = F.when(checks["length_ratio"], 1.0).otherwise(0.7)
    for rule in (rules or {}).values():
        score = score * F.when(rule, 1.0).otherwise(0.9)
    every = {**checks, **(rules or {})}
    valid = F.lit(True)
    for c in every.values():
        valid = valid & F.coalesce(c, F.lit(False))
    return F.struct(F.create_map(*[x for k, c in every.items() for x in (F.lit(k), c)]).alias("checks"), score.alias("score"), valid.alias("is_valid"))


def triage(agreement: Column, confidence_of: Column, accept: float = 0.9, review: float = 0.5, confidence: float = 0.6) -> Column:
    return F.when((agreement >= accept) & (confidence_of >= confidence), "auto_train").when(agreement >= review, "needs_review").otherwise("discarded")


def trainable(df: DataFrame, used: DataFrame, key: str, agreement: float = 0.8, confidence: float = 0.6) -> DataFrame:
    """Rows that agree, are confident and were not used."""
    return df.where((F.col("agreement") >= agreement) & (F.col("confidence") >= confidence)).join(used.select(key), key, "left_anti")


def promotion(frequency: Column, before: Column, after: Column, age_days: Column, promoted: Column, least: int = 3, gain: float = 0.05, confidence: float = 0.80, age: int = 30) -> Column:
    """struct<promote,reasons>: reasons name the criteria that fail."""
    tests = {"frequency": frequency >= least, "gain": after - before >= gain, "confidence": after >= confidence, "age": F.coalesce(age_days, F.lit(999)) <= age, "already_promoted": ~promoted}
    reasons = F.filter(F.array(*[F.when(~t, F.lit(k)) for k, t in tests.items()]), lambda r: r.isNotNull())
    return F.struct((F.size(reasons) == 0).alias("promote"), reasons.alias("reasons"))


def rule_indicator(confidence: Column, flagged: Column, usage: Column, days_since_review: Column, days_since_seen: Column) -> Column:
    """struct<score,indicator> of a correction rule."""
    score = F.when(confidence < 0.60, 3).when(confidence < 0.80, 1).otherwise(0) + F.when(flagged, 2).otherwise(0) + F.when((usage > 50) & (days_since_review > 30), 2).otherwise(0)
    label = F.when(score >= 5, "urgent").when(score >= 3, "review").when((score == 0) & (days_since_seen <= 3), "new").otherwise("ok")
    return F.struct(score.alias("score"), label.alias("indicator"))


def memory(df: DataFrame, keys: list[str], gain: str, order: str) -> DataFrame:
    """keys, frequency, max_gain and last (the newest row's gain)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"), F.max(gain).alias("max_gain"), F.max_by(gain, order).alias("last"))


def _bounded_split(df: DataFrame, rank: Column, n: Column, train: float, val: float) -> DataFrame:
    a = F.floor(n * train)
    b = a + F.floor(n * val)
    return df.withColumn("split", F.when(rank <= a, "train").when(rank <= b, "val").otherwise("test"))


def ordered_split(df: DataFrame, best_first: list[str], key: str, train: float, val: float) -> DataFrame:
    """Contiguous splits by quality with exact sizes.

    Ranks are two-level: counts per quality value are summed over values, and rows are ranked within
    range partitions, so no single task sorts all rows.
    """
    order = [*(F.desc(c) for c in best_first), F.asc(key)]
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    counts = sorted((r["__p"], r["c"]) for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).collect())  # one row per task
    bases, total = [], 0
    for part, c in counts:
        bases.append((part, total))
        total += c
    before = df.sparkSession.createDataFrame(bases or [(0, 0)], "__p int, base long")
    rows = ranged.withColumn("__i", inside).join(F.broadcast(before), "__p")
    return _bounded_split(rows, F.col("__i") + F.col("base"), F.lit(total), train, val).drop("__p", "__i", "base")


def hash_split(df: DataFrame, key: str, train: float, val: float, seed: int) -> DataFrame:
    """Seeded splits of exact sizes: rows in hash order."""
    return ordered_split(df.withColumn("__h", F.xxhash64(key, F.lit(seed))), ["__h"], key, train, val).drop("__h")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int, existing: DataFrame | None = None) -> DataFrame:
    """n rows by seeded hash, none of existing."""
    pool = df.join(existing.select(key), key, "left_anti") if existing is not None else df
    return pool.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def hybrid_sample(df: DataFrame, key: str, confidence: str, n: int, share: float, seed: int = 42) -> DataFrame:
    """share of n by least confidence, the rest by seeded hash from what is left."""
    first = df.orderBy(confidence, key).limit(int(n * share))
    return first.unionByName(fixed_sample(df, key, n - int(n * share), seed, first))


def margin_sample(df: DataFrame, key: str, confidence: str, n: int) -> DataFrame:
    """key, margin: the n rows of greatest margin, one less the confidence, ties to the smallest key."""
    return df.select(key, (1 - F.col(confidence)).alias("margin")).orderBy(F.desc("margin"), key).limit(n)


def should_train(new: Column, days: Column, least: int, force: int) -> Column:
    return (new >= least) | (days >= force)


def accepts(before: Column, after: Column, worst: float = 0.02) -> Column:
    """A retrained model's error may grow by worst of the old one; from zero to 0.05."""
    return F.when(before == 0, after <= 0.05).otherwise((after - before) / before <= worst)


def version_key(v: Column) -> Column:
    """struct(major, minor, patch) that orders semantic versions."""
    part = lambda i: F.coalesce(F.get(F.split(F.regexp_replace(v, "^v", ""), r"[.-]"), F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def evicted(df: DataFrame, keys: list[str], newest: list[Column], keep: int) -> DataFrame:
    """Rows beyond the newest keep of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("__r") > keep).drop("__r")
