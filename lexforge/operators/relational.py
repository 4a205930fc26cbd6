"""Filters, joins, ranking, upserts, set operations and paging as DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import cut


def column_of(df: DataFrame, name: str) -> Column:
    """The column called name; names are only ever taken from the frame itself."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return df[name]


def escape_like(text: str) -> str:
    """text with LIKE's wildcards and escape taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_any(df: DataFrame, text: str, columns: list[str]) -> Column:
    """Case-insensitive substring in any of columns."""
    return reduce(lambda a, b: a | b, [column_of(df, c).ilike(f"%{escape_like(text)}%") for c in columns])


def filtered(df: DataFrame, equals: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, among: dict | None = None, prefix: dict | None = None) -> DataFrame:
    """Conjunction of the optional predicates given; absent ones filter nothing."""
    tests = [column_of(df, c) == v for c, v in (equals or {}).items() if v is not None]
    tests += [column_of(df, c) >= v for c, v in (at_least or {}).items() if v is not None]
    tests += [column_of(df, c) <= v for c, v in (at_most or {}).items() if v is not None]
    tests += [column_of(df, c).isin(list(v)) for c, v in (among or {}).items() if v is not None]
    tests += [column_of(df, c).startswith(v) for c, v in (prefix or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def map_contains(labels: Column, wanted: dict[str, str]) -> Column:
    """Every wanted key of a map column has the wanted value."""
    return reduce(lambda a, b: a & b, [F.coalesce(labels[k] == v, F.lit(False)) for k, v in wanted.items()], F.lit(True))


def changed_pairs(df: DataFrame, original: str, corrected: str) -> DataFrame:
    """Rows whose two texts are both non-blank and differ."""
    a, b = df[original], df[corrected]
    return df.where((F.trim(a) != "") & (F.trim(b) != "") & (a != b))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of size rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; give order a last key that makes it total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def lookup_left(df: DataFrame, side: DataFrame, on: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join with defaults for what is missing."""
    out = df.join(side, on, "left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out


def insert_or_ignore(have: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """have and those rows of new whose keys it lacks (nulls compare equal), one per key."""
    fresh = top_per_key(new, keys, order)
    match = reduce(lambda a, b: a & b, [fresh[k].eqNullSafe(have[k]) for k in keys])
    return have.unionByName(fresh.join(have.select(*keys), match, "left_anti"), allowMissingColumns=True)


def upsert_counts(have: DataFrame, new: DataFrame, keys: list[str], count: str = "frequency") -> DataFrame:
    """Counter table: count grows by the number of new rows, other columns take the newer value."""
    others = [c for c in have.columns if c not in (*keys, count)]
    added = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *(F.max(c).alias(f"__{c}") for c in others if c in new.columns))
    out = have.join(added, keys, "full")
    picked = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in others]
    return out.select(*keys, (F.coalesce(count, F.lit(0)) + F.coalesce("__n", F.lit(0))).alias(count), *picked)


def update_by_key(df: DataFrame, changes: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """df with the allowed columns taken from changes where it has a non-null value for the key."""
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in allowed if c in changes.columns))
    out = df.join(new, keys, "left")
    return out.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if f"__{c}" in new.columns else F.col(c) for c in df.columns))


def delete_where(df: DataFrame, condition: Column, children: list[tuple[DataFrame, list[str]]] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """df without the rows that satisfy condition (null counts as no), and children without their orphans."""
    gone = df.where(F.coalesce(condition, F.lit(False)))
    rest = df.where(~F.coalesce(condition, F.lit(False)))
    return rest, [child.join(gone.select(*keys), keys, "left_anti") for child, keys in children or []]


def merge_prioritised(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union distinct by keys; of equal keys the row of the earliest frame stays."""
    tagged = [f.withColumn("__source", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [F.col(c) for c in every.columns if c not in (*keys, "__source")]
    return top_per_key(every, keys, [F.col("__source"), *rest]).drop("__source")


def sets_conflict(a: Column, b: Column) -> Column:
    """Both sets are non-empty and differ."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b)))


def positional_diff(original: Column, corrected: Column) -> Column:
    """array<struct<original,corrected>> of the words that differ, where both have as many words."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    pairs = F.zip_with(words(original), words(corrected), lambda x, y: F.struct(x.alias("original"), y.alias("corrected")))
    return F.when(F.size(words(original)) == F.size(words(corrected)), F.filter(pairs, lambda p: p.original != p.corrected))


def near_in_time(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of rows of a key whose times lie within seconds, joined by time bucket, a before b."""
    base = df.withColumn("__t", F.unix_timestamp(df[ts].cast("timestamp"))).withColumn("__b", F.floor(F.col("__t") / seconds))
    left = base.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    a, b = left.alias("a"), base.alias("b")
    match = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__b") == F.col("b.__b")) & (F.abs(F.col("a.__t") - F.col("b.__t")) <= seconds)
    return a.join(b, match)


def lineage(edges: DataFrame, child: str, parent: str, rounds: int = 32) -> DataFrame:
    """(child, ancestor, distance) up to every root, by doubling: a round sets paths on the end of the longest.

    A least path of up to twice the length is one of just that length and another after it, so only
    the longest are joined and each path is met once, not once per place to cut it.
    """
    paths = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance"))
    known, length = cut(paths.distinct()), 1
    size = known.count()
    for _ in range(rounds):
        more = known.where(F.col("distance") == length).alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.child"))
        more = more.select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        known = cut(known.unionAll(more).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))
        now = known.count()
        if now == size:
            return known
        size, length = now, 2 * length
    return known


def infer_roles(columns: list[str]) -> dict[str, str]:
    """Source and target columns of a translation set, by name and else by position."""
    find = lambda *names: next((c for c in columns if any(n in c.lower() for n in names)), None)
    source = find("english", "source", "en") or (columns[0] if columns else None)
    target = find("arabic", "target", "ar")
    if target in (None, source):
        target = columns[1] if len(columns) > 1 else None
    return {"source": source, "target": target}
