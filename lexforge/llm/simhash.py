"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through BK-trees.

Words are runs of characters other than space and tab to carriage return, with A-Z lower-cased.
Fewer words than a shingle make one shingle of the whole sequence; texts without a word, and null
texts, have fingerprint zero, which is linked like any other. Repeated rows share a fingerprint,
so each fingerprint is searched once whatever the number of copies. Ids may be of any ordered type,
repeat or be null: a component is named by its smallest id, null if it has none. A text is one
fingerprint whatever its length; other columns pass by, whatever their names.

Search: 64 bits are cut in n blocks; two fingerprints within radius r agree on at least n-r of
them, so a BK-tree per choice of n-r blocks and their value - a shard tree - holds every pair. n
grows with the number of fingerprints, so that a shard of unlike ones stays small; a shard that is
crowded all the same is cut in parts, and every pair of parts is a shard of its own. Their number
grows with the input, so shard trees are not broadcast: each is built in the task that its own
queries are dealt to, shard by shard. A shard's links leave the task as one spanning star per local
component, never as pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import components, local_roots, map_batches, staged, text_of


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the text's shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)],
            dtype=np.uint64,
        )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row's whole text."""
    return _printed(df.select(df[id_col].alias("id"), df[text_col].alias("t")), ["id"], width)


def _printed(df: DataFrame, carry: list[str], width: int = 4) -> DataFrame:
    """The columns of carry and fp, the fingerprint of column t."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fp": np.array([fingerprint(text_of(t), width) for t in frame["t"]], dtype=np.uint64).view(np.int64)})

    return map_batches(df, run, "fp long", carry)


def blocks_for(count: int, radius: int, shard: int = 64) -> int:
    """Least number of blocks, up to 2 * radius, with which a shard holds about shard of count random fingerprints."""
    return next((n for n in range(radius + 1, 2 * radius) if count >> ((n - radius) * 64 // n) <= shard), 2 * radius) if radius else 1


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """array of shard keys: for every choice of blocks - radius blocks, its number and the bits of the blocks."""
    if blocks == 1:
        return F.array(fp)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(number).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(value)
    return F.array(*keys)


class BKForest:
    """BK-trees over the distinct values of many shards, built and searched level by level.

    Children of a node are keyed by their integer Hamming distance to it. All shards advance
    together: on each level every waiting value meets its current node, the first value at a new
    distance becomes that child, and the rest move down to it.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray) -> None:
        self.values = values
        order = np.argsort(shard, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = shard[order][1:] != shard[order][:-1]
        group = np.cumsum(first) - 1
        heads = order[first]
        self.root = np.empty(len(values), dtype=np.int64)
        self.root[order] = heads[group]
        at, waiting = self.root.copy(), np.setdiff1d(np.arange(len(values)), heads)
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(waiting):
            node = at[waiting]
            key = node * 65 + np.bitwise_count(values[waiting] ^ values[node]).astype(np.int64)
            _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[where]
            links.append((node[where], key[where] % 65, child))
            at[waiting] = child[inverse]
            keep = np.ones(len(waiting), dtype=bool)
            keep[where] = False
            waiting = waiting[keep]
        if links:
            parent, dist, child = (np.concatenate(x) for x in zip(*links, strict=True))
            o = np.lexsort((dist, parent))
            self.key, self.child = (parent * 65 + dist)[o], child[o]
        else:
            self.key = self.child = np.zeros(0, dtype=np.int64)

    def within(self, query: np.ndarray, radius: int):
        """Yields (query, found) index arrays with distance <= radius in the query's own shard."""
        node, visits = self.root[query], query
        while len(visits):
            d = np.bitwise_count(self.values[visits] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield visits[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            total = int(n.sum())
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            visits, node = np.repeat(visits, n), self.child[at]


def shard_links(frame: pd.DataFrame, radius: int, budget: int = 2_000_000) -> pd.DataFrame:
    """Spanning stars (a, b) of the links between fingerprints within each shard of frame(shard, fp).

    Queries go in blocks whose visits cannot exceed budget by more than one shard.
    """
    shard = pd.factorize(frame["shard"])[0]
    turn = np.argsort(shard, kind="stable")
    work = np.cumsum(np.bincount(shard)[shard[turn]])
    forest = BKForest(frame["fp"].to_numpy().view(np.uint64), shard)
    n = len(frame)
    root = np.arange(n)
    at = 0
    while at < n:
        done = work[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(work, done + budget, "right")))
        for q, f in forest.within(turn[at:to], radius):
            a, b = root[q], root[f]
            apart = a != b
            if apart.any():
                root = local_roots(n, a[apart], b[apart])[root]
        at = to
    node = frame["fp"].to_numpy()
    least = pd.Series(node).groupby(root).transform("min").to_numpy()
    far = least != node
    return pd.DataFrame({"a": node[far], "b": least[far]})


def _streamed(frames, radius: int, rows: int = 50_000):
    """shard_links over frames sorted by shard, some whole shards at a time."""
    held = None
    for frame in frames:
        held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
        if len(held) >= rows:
            last = held["shard"] == held["shard"].iloc[-1]
            if not last.all():
                yield shard_links(held[~last].reset_index(drop=True), radius)
                held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield shard_links(held, radius)


def fingerprint_links(distinct: DataFrame, count: int, radius: int = 4, part: int = 2048) -> DataFrame:
    """Links (a, b) between the fingerprints of distinct(fp) that span all pairs within radius."""
    if not 0 <= radius < 32:
        raise ValueError("radius must be from 0 to 31")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks_for(count, radius))).alias("shard"))
    crowded = staged(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 2 * part), "crowded")
    dealt = dealt.join(crowded, "shard", "left").withColumn("n", F.ceil(F.coalesce("c", F.lit(1)) / F.lit(part)).cast("int"))
    dealt = dealt.withColumn("mine", F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp", "shard"), F.col("n"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
    dealt = dealt.select("fp", F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other")).alias("shard"))  # two shards of one number only meet
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInPandas(lambda frames: _streamed(frames, radius), "a long, b long")


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, class): the smallest fingerprint reachable over links of at most radius bits, for every fp of prints."""
    distinct = staged(prints.select("fp").distinct(), "prints")
    joined = components(fingerprint_links(distinct, distinct.count(), radius))
    return distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component (smallest id reachable over links of at most radius bits)."""
    prints = staged(fingerprints(df, id_col, text_col), "simhash")
    lows = prints.groupBy("fp").agg(F.min("id").alias("low")).join(staged(classes(prints, radius), "classes"), "fp")
    named = lows.join(lows.groupBy("class").agg(F.min("low").alias("component")), "class").select("fp", "component")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprint and component of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the row with the smallest doc_id.

    Rows have numbers of their own, so rows that share a doc_id stay or go each for its own text;
    of rows with one doc_id in one group, and of groups without a doc_id, the first row stays.
    """
    names = {c: {"text": "t", "doc_id": "id"}.get(c, f"k{i}") for i, c in enumerate(docs.columns)}
    given = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    rows = staged(_printed(given, list(names.values())).withColumn("row", F.monotonically_increasing_id()), "simhash")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stay = rows.groupBy("fp").agg(F.min(order).alias("low")).join(classes(rows), "fp").groupBy("class").agg(F.min("low").alias("low"))
    kept = rows.join(stay.select("low.row"), "row", "left_semi")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
