"""Exact and shingle duplicates, similarity graphs, components, cluster merging."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from lexforge.functions.normalize import bound, words
from lexforge.session import cut, text_runs, written


def _at_hand(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """rows of a number each, marked for a broadcast if there are few enough."""
    return F.broadcast(rows) if rows.count() <= most else rows


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """hash, n, first: texts that occur twice or more, with the smallest key."""
    return df.groupBy(F.sha2(text, 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def group_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """hash, first, key: every member of the groups, a row each, so a group of any size is fine."""
    hashed = df.select(key, F.sha2(text, 256).alias("hash"))
    return hashed.join(exact_groups(df, key, text).select("hash", "first"), "hash")


def shingles(c: Column, width: int = 5) -> Column:
    """Distinct word shingles of a text; a shorter text is one shingle, an empty one has none."""

    def cut(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, F.array_distinct(full)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return bound(words(c), cut)


def shingle_sets(df: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """key, s, h: sorted distinct 64-bit hashes of the word shingles of each text that has a word, and their digest.

    A shorter text is one shingle. A word is hashed once, a shingle's hash is made of its words'.
    """
    base = np.uint64(0x5851F42D4C957F2D)

    class Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
            return h

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Hashes()
        for batch in batches:
            for some in text_runs(batch, "t", 8_000_000):
                lists = [t.split() for t in some.column("t").cast(pa.binary()).to_pylist()]  # bytes are split at the white space of words()
                if len(told) > 500_000:
                    told.clear()
                every = np.array(list(map(told.__getitem__, chain.from_iterable(lists))), dtype=np.uint64)
                rolled = every.copy()
                for i in range(1, min(width, len(every))):
                    rolled[: len(every) - i] = rolled[: len(every) - i] * base + every[i:]
                rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                rolled = (rolled ^ (rolled >> np.uint64(29))).view(np.int64)
                sets, digests, rows, at = [], [], [], 0
                for row, ws in enumerate(lists):
                    n = len(ws)
                    if n >= width:
                        sets.append(np.unique(rolled[at : at + n - width + 1]))
                    elif n:
                        sets.append(np.frombuffer(blake2b(b" ".join(ws), digest_size=8).digest(), dtype=np.int64))
                    if n:
                        rows.append(row)
                        digests.append(sha256(sets[-1].tobytes()).hexdigest())
                    at += n
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(digests, pa.string())], ["key", "s", "h"])

    shape = StructType().add("key", df.schema[key].dataType).add("s", ArrayType(LongType())).add("h", "string")
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, shape)


def shingle_links(df: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """a, b, similarity: texts whose shingle sets have a Jaccard index of threshold or more.

    Shingles are their 64-bit hashes from the start. Equal sets are one class and are linked only to
    their smallest key. Of the others each gives up only the prefix of its rarest shingles that a
    partner must share (prefix filtering), so shingles that stand everywhere join nothing; lengths
    and the places of the shared shingle bound the pairs further.
    """
    sets = written(shingle_sets(df, key, text, width).withColumn("row", F.monotonically_increasing_id()))  # numbers hold once they are written
    named = sets.groupBy("h").agg(F.min(F.struct("key", "row")).alias("f"))
    twins = sets.select("h", "row", F.col("key").alias("b")).join(named, "h").where("row <> f.row").select("row", F.col("f.key").alias("a"), "b")
    twins = cut(twins)
    n, least = F.col("n"), F.ceil(F.col("n") * threshold - 1e-9)
    more = lambda c: F.greatest(F.lit(1), F.floor(c / 10))  # noqa: E731  the first of the shared ones stand among the first n - least + more of either text
    front = sets.select("row", F.size("s").alias("n"), "s").select("row", "n", F.slice("s", F.lit(1), (n - least + more(n)).cast("int")).alias("s"))
    front = front.join(_at_hand(twins.select("row")), "row", "left_anti").select("row", "n", F.explode("s").alias("x"))
    met = front.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("x")
    open_ = cut(front.join(met, "x").groupBy("row", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= more(least)).select("row"))
    classes = written(sets.join(_at_hand(open_), "row").select("key", "s"))
    twins = twins.where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    flat = classes.select("key", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = flat.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one text alone are its rarest: they fill the front of its order and join nothing
    shared = flat.join(often, "x").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))
    most = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("xs"))
    prefix = shared.where(most > 0).select("key", "n", F.posexplode(F.slice("xs", F.lit(1), most.cast("int"))).alias("i", "e"), F.size("xs").alias("m"))
    prefix = prefix.select("key", "n", (F.col("n") - F.col("m") + F.col("i")).alias("at"), F.col("e.x").alias("x"))
    a, b = prefix.alias("a"), prefix.alias("b")
    # at place i of an order of n, at most n - i shingles can still be shared
    need = F.ceil((F.col("a.n") + F.col("b.n")) * threshold / (1 + threshold) - 1e-9)
    fits = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold) & (F.col("a.n") - F.col("a.at") >= need) & (F.col("b.n") - F.col("b.at") >= need)
    near = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.key") < F.col("b.key")) & fits)
    pairs = near.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    s = classes.select("key", "s")
    both = pairs.join(s.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    sim = bound(F.size(F.array_intersect("x", "y")), lambda n: n / (F.size("x") + F.size("y") - n))
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold).unionAll(twins)


def shared_grams(docs: DataFrame, items: DataFrame, key: str, item: str, text: str, width: int, most_broadcast: int = 2_000_000) -> DataFrame:
    """key, item, shared: how many distinct lower-cased word grams of an item each document has.

    The grams of items, the small side, are counted and go to every task only up to most_broadcast;
    beyond, the join is dealt out by hash. Documents give up hashes, not strings; a hit is compared
    word by word.
    """
    rolled = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - width + 1), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(x, i, width)).alias("h")))
    hashes = lambda w: bound(F.transform(w, lambda x: F.xxhash64(x)), rolled)  # noqa: E731  a word is hashed once, not once per gram
    listed = lambda df, k: df.select(k, words(F.lower(text)).alias("w")).where(F.size("w") >= width)
    grams = listed(items, item).select(item, "w", F.explode(hashes(F.col("w"))).alias("e")).select(item, "e.h", F.slice("w", F.col("e.i"), width).alias("g")).distinct()
    grams = cut(grams)
    rows = listed(docs, key).select(key, "w", F.explode(hashes(F.col("w"))).alias("e"))
    own = F.slice("w", F.col("e.i"), width)
    if grams.count() <= most_broadcast:
        hits = rows.withColumn("h", F.col("e.h")).join(F.broadcast(grams), "h").where(own == F.col("g"))
    else:
        hits = rows.select(key, own.alias("own"), F.col("e.h").alias("h")).join(grams, "h").where("own = g")
    found = hits.select(key, item, "g").distinct()
    return found.groupBy(key, item).agg(F.count(F.lit(1)).alias("shared"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the smallest node reachable over edges (a, b), by minimum labels with jumps.

    Every round a node takes the least label around it, then the label of its label, so paths halve.
    Lineage is cut by checkpoint().
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    last = None
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(around, "a").select("a", F.least("label", "near").alias("label"))
        jump = stepped.select(F.col("a").alias("label"), F.col("label").alias("up"))
        labels = cut(stepped.join(jump, "label").select("a", F.least("label", "up").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == last:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def cosine_links(df: DataFrame, key: str, vector: str, threshold: float, pivots: int = 16) -> DataFrame:
    """a, b, similarity for all pairs of unit directions at threshold or more, exactly.

    Vectors are dealt to the cell of their nearest pivot (a bounded sample of vectors); a vector is
    also sent to every cell whose pivot is near enough, by the triangle inequality on angles, to
    hold a partner. Each pair meets in the cell of its smaller key's own pivot.
    """
    angle = math.acos(min(1.0, threshold))
    rows = df.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where(norm(F.col("v")) > 0).select("key", bound(norm(F.col("v")), lambda n: F.transform("v", lambda x: x / n)).alias("v"))
    chosen = rows.orderBy(F.xxhash64("key"), "key").limit(pivots).select(F.col("key").alias("pivot"), F.col("v").alias("p"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    all_pivots = F.broadcast(chosen.agg(F.array_sort(F.collect_list(F.struct("pivot", "p"))).alias("ps")))  # bounded by pivots
    far = F.transform("ps", lambda q: F.struct(F.acos(F.greatest(F.least(dot(F.col("v"), q.p), F.lit(1.0)), F.lit(-1.0))).alias("d"), q.pivot.alias("pivot")))
    near = rows.join(all_pivots).select("key", "v", far.alias("ds")).withColumn("own", F.array_min("ds"))
    homes = near.select("key", "v", F.col("own.pivot").alias("cell"))
    guests = near.select("key", "v", F.explode(F.filter("ds", lambda d: d.d <= F.col("own").d + 2 * angle + 1e-9)).alias("d")).select("key", "v", F.col("d.pivot").alias("cell"))
    a, b = homes.alias("a"), guests.alias("b")
    both = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.key") < F.col("b.key")))
    return both.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), dot(F.col("a.v"), F.col("b.v")).alias("similarity")).where(F.round("similarity", 6) >= threshold)


def merged_clusters(df: DataFrame, named: DataFrame, links: DataFrame, key: str, text: Column) -> DataFrame:
    """component, n, representative (longest text, then smallest key), score (mean link similarity).

    A column n of links tells how many a row sums up.
    """
    members = named.join(df.select(F.col(key).alias("node"), text.alias("t")), "node")
    sims = links.join(named.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg((F.sum("similarity") / F.sum(F.col("n") if "n" in links.columns else F.lit(1))).alias("score"))
    best = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", F.struct(F.char_length("t"), -F.col("node"))).alias("representative"))
    return best.join(sims, "component")


def centroids(df: DataFrame, named: DataFrame, key: str, vector: str) -> DataFrame:
    """component, centroid: the unit vector along the mean of the members' unit vectors, place by place."""
    unit = bound(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    places = named.join(df.select(F.col(key).alias("node"), F.posexplode(unit).alias("i", "x")), "node").groupBy("component", "i").agg(F.avg("x").alias("x"))
    mean = places.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("m"))  # one entry per dimension
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select("component", bound(norm, lambda n: F.when(n > 0, F.transform("m", lambda x: x / n)).otherwise(F.col("m"))).alias("centroid"))


def without_conflicts(links: DataFrame, conflict: Column) -> DataFrame:
    """Links whose two sides may be merged."""
    return links.where(~F.coalesce(conflict, F.lit(False)))
