"""Embedding near-dedup by NN-descent, with exact counts of the links found.

Vectors that are null, zero or hold null or non-finite components link with nothing, and vectors
of different lengths do not link with each other. Bit-identical vectors are one node with a weight,
so copies cost nothing. Repeated or null ids are fine: nodes have numbers of their own, ids stay as
they were, and a component is named by its smallest id. Of equal similarities in a list the smaller
node number stays; a list cut in a tie counts as saturated like any other. Other columns pass by,
whatever their names; a vector of any length is one row.

1. A first neighbour graph comes from sign-projection tables, as many as a pair at t needs to meet
   by angle alone with the chance of the floor, whatever the number of nodes. A crowded cell is cut
   in blocks, and every pair of blocks meets.
2. NN-descent: in every round each node's neighbours and reverse neighbours are compared with each
   other, and each keeps its best. Entries under cos(2*acos(t)) are not kept: two links of one node
   can never be further apart, so no path of links is lost.
3. Edges at or over t in double precision give components.
4. A list that is full of links is saturated and may hide links to other components. Saturated
   nodes get further lists that hold only nodes of other components; components that these link
   become one, and lists are made again until no link is left.
5. Links are counted. A list that is not saturated holds them all; saturated nodes, and all nodes of
   components of at most whole nodes, are compared with their whole component in blocks of bounded
   size, and only counts leave a task. Pairs of saturated nodes are never written.
6. A new sample of nodes is compared with all nodes to audit recall: the mean over nodes with links of
   the share of linked nodes found. It grows until it holds enough nodes with links. Tables are
   doubled until recall reaches the floor; if it does not, the run fails rather than return less.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import components, map_batches, map_tasks, staged


@dataclass(frozen=True)
class Descent:
    """Parameters of the search."""

    threshold: float = 0.9
    k: int = 16
    tables: int = 12
    cell: int = 128
    most_cell: int = 512
    rounds: int = 2
    block: int = 2048
    most_block: int = 8192
    whole: int = 4096
    audit: int = 512
    recall: float = 0.97
    attempts: int = 3


def prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """nid, id, twin (128-bit name of the exact vector; null where it cannot link), unit (float64 bytes)."""

    def start():
        part, at = TaskContext.get().partitionId(), 0

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal at
            rows = []
            for v in frame["v"]:
                twin = unit = None
                if v is not None and len(v):
                    x = np.array([np.nan if e is None else e for e in v], dtype=np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        scaled = x / top
                        unit = (scaled / np.sqrt(scaled @ scaled)).tobytes()
                        twin = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                rows.append(((part << 33) + at, twin, unit))
                at += 1
            return pd.DataFrame(rows, columns=["nid", "twin", "unit"])

        return run

    return map_tasks(df.select(df[id_col].alias("id"), df[vec_col].alias("v")), start, "nid long, twin binary, unit binary", carry=["id"])


def _matrix(col, dtype=np.float32) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in col]).astype(dtype)


def _best_rows(ids: np.ndarray, comp: np.ndarray, v: np.ndarray, k: int, floor: float, second: np.ndarray | None = None) -> tuple[list, list, list]:
    """Each row's best k rows of other components at or over floor, as (u, v, sim).

    With second, a row is compared only with rows of the other kind: of two blocks, pairs across.
    """
    out: tuple[list, list, list] = ([], [], [])
    n = min(k, len(ids) - 1)
    if n <= 0:
        return out
    for at in range(0, len(ids), 512):
        s = v[at : at + 512] @ v.T
        s[comp[at : at + 512, None] == comp[None]] = -2
        if second is not None:
            s[second[at : at + 512, None] == second[None]] = -2
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        sim = np.take_along_axis(s, top, 1)
        row, col = np.nonzero(sim >= floor)
        for have, more in zip(out, (ids[at + row], ids[top[row, col]], sim[row, col].astype(float)), strict=True):
            have += list(more)
    return out


def _grouped(key: str, k: int, floor: float):
    """mapInPandas over frames sorted by key: best pairs within each run of key; where a column side holds 0 and 1, across it."""

    def flush(held: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        ids, comp, units = held["m"].to_numpy(), held["comp"].to_numpy(), held["unit"]
        side = held["side"].to_numpy() if "side" in held else np.zeros(len(held), np.int32)
        alike = units.map(len).nunique() == 1  # else lengths differ between groups, never within one
        vectors = _matrix(units) if alike else None
        cuts = np.flatnonzero(held[key].to_numpy()[1:] != held[key].to_numpy()[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(held)], strict=True):
            if b - a > 1:
                group = vectors[a:b] if alike else _matrix(units.iloc[a:b])
                second = side[a:b] if side[a:b].any() else None
                for have, more in zip(out, _best_rows(ids[a:b], comp[a:b], group, k, floor, second), strict=True):
                    have += more
        return pd.DataFrame({"u": out[0], "v": out[1], "sim": out[2]}).astype({"u": "int64", "v": "int64", "sim": "float64"})

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            if len(held) > 8192:
                last = held[key] == held[key].iloc[-1]
                if not last.all():
                    yield flush(held[~last])
                    held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield flush(held)

    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The best k of each list."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def tables_for(rule: Descent, bits: int) -> int:
    """Tables in which two vectors at the threshold share a cell at least once with chance 1 - (1 - recall) / 2."""
    alone = (1 - math.acos(rule.threshold) / math.pi) ** bits
    return 1 if alone >= 1 else math.ceil(math.log((1 - rule.recall) / 2) / math.log1p(-alone))


def bits_for(rule: Descent, count: int) -> int:
    return max(1, math.ceil(math.log2(max(2, count / rule.cell))))


def first_graph(nodes: DataFrame, rule: Descent, count: int, floor: float, seed: int) -> DataFrame:
    """(u, v, sim) from sign-projection cells, between nodes of different comp."""
    bits = bits_for(rule, count)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cells(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = frame["unit"].map(len)
        for size in sorted(set(sizes)):
            own = frame[sizes == size]
            v = _matrix(own["unit"])
            rng = np.random.default_rng([seed, size])
            planes = rng.normal(size=(v.shape[1], rule.tables * bits)).astype(np.float32)
            sign = (v @ planes > 0).reshape(len(v), rule.tables, bits)
            code = (sign << np.arange(bits)).sum(2) + (np.arange(rule.tables) << bits) + size * (rule.tables << bits)
            out.append(pd.DataFrame({"cell": code.ravel(), "m": np.repeat(own["nid"].to_numpy(), rule.tables)}))
        return pd.concat(out, ignore_index=True)

    celled = staged(map_batches(nodes.select("nid", "unit"), cells, "cell long, m long"), "cells")
    crowded = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rule.most_cell)
    # a crowded cell is cut in blocks of a node's own hash in this cell; block i meets block j in the group (i, j)
    salted = celled.join(crowded, "cell", "left").withColumn("nb", F.ceil(F.coalesce("c", F.lit(1)) / F.lit(rule.block)).cast("int"))
    salted = salted.withColumn("mine", F.pmod(F.xxhash64("m", "cell", F.lit(seed)), F.col("nb")).cast("int"))
    salted = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    group = F.concat_ws(":", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")
    salted = salted.select(group, "m", (F.col("mine") > F.col("other")).cast("int").alias("side"))
    dealt = salted.join(nodes.select(F.col("nid").alias("m"), "comp", "unit"), "m")
    found = dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInPandas(_grouped("cell", rule.k, floor), "u long, v long, sim double")
    return staged(_top(found, rule.k), "graph")


def met(graph: DataFrame, nodes: DataFrame, rule: Descent, floor: float) -> DataFrame:
    """(u, v, sim): members of each node's list and reverse list meet, where they are among nodes."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turned = graph.select(F.col("v").alias("w"), F.col("u").alias("m"))
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("w", "m"), "m"))
    turned = turned.withColumn("r", rank).where(F.col("r") <= rule.k).drop("r")
    own = graph.select(F.col("u").alias("w"), F.col("u").alias("m")).distinct()
    lists = graph.select(F.col("u").alias("w"), F.col("v").alias("m")).unionAll(turned).unionAll(own).distinct()
    dealt = lists.join(nodes.select(F.col("nid").alias("m"), "comp", "unit"), "m")
    return dealt.repartition(parts, "w").sortWithinPartitions("w").mapInPandas(_grouped("w", rule.k, floor), "u long, v long, sim double")


def refine(graph: DataFrame, nodes: DataFrame, rule: Descent, floor: float) -> DataFrame:
    """One round of neighbours-of-neighbours: members of each list meet, and lists keep their best."""
    return staged(_top(graph.unionAll(met(graph, nodes, rule, floor)), rule.k), "graph")


def confirmed(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges of the graph whose cosine in double precision reaches threshold."""
    near = graph.where(F.col("sim") >= threshold - 1e-4).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = near.join(nodes.select(F.col("nid").alias("a"), F.col("unit").alias("x")), "a").join(nodes.select(F.col("nid").alias("b"), F.col("unit").alias("y")), "b")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, own in frame.groupby(frame["x"].map(len)):
            sim = np.einsum("ij,ij->i", _matrix(own["x"], np.float64), _matrix(own["y"], np.float64))
            keep.append(own.loc[sim >= threshold, ["a", "b"]])
        return pd.concat(keep)

    return map_batches(both, run, "a long, b long")


def saturated(graph: DataFrame, rule: Descent) -> DataFrame:
    """nid of the nodes whose lists are full of links."""
    links = graph.where(F.col("sim") >= rule.threshold - 1e-4).groupBy(F.col("u").alias("nid")).agg(F.count(F.lit(1)).alias("n"))
    return links.where(F.col("n") >= rule.k).select("nid")


def widened(graph: DataFrame, nodes: DataFrame, named: DataFrame, rule: Descent, count: int, floor: float, seeds: list[int]) -> DataFrame:
    """named, with the components made one whose links only saturated lists had cut off.

    A link is lost by a cut only where both lists are full of links, so only such nodes meet again,
    in the same cells and lists, and keep their best of other components. Every round that finds a
    link joins components, and the last one finds none.
    """
    full = staged(nodes.join(saturated(graph, rule), "nid"), "saturated")
    alone = full.select(F.col("nid").alias("node")).join(named, "node", "left_anti")
    named = staged(named.unionAll(alone.select("node", F.col("node").alias("component"))), "named")
    while True:
        some = staged(full.drop("comp").join(named.select(F.col("node").alias("nid"), F.col("component").alias("comp")), "nid"), "saturated")
        if some.select("comp").distinct().limit(2).count() < 2:
            return named
        outer = None
        for seed in seeds:
            more = first_graph(some, rule, count, floor, seed)
            outer = more if outer is None else staged(_top(outer.unionAll(more), rule.k), "graph")
        for _ in range(rule.rounds):
            outer = staged(_top(outer.unionAll(met(graph.unionAll(outer), some, rule, floor)), rule.k), "graph")
        links, comp = confirmed(outer, nodes, rule.threshold), some.select("nid", "comp")
        links = links.join(comp.toDF("a", "x"), "a").join(comp.toDF("b", "y"), "b")
        links = staged(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return named
        joined = components(links).toDF("component", "whole")
        named = staged(named.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "named")


def counted(nodes: DataFrame, named: DataFrame, pairs: DataFrame, full: DataFrame, rule: Descent) -> DataFrame:
    """(nid, links, near): weight and number of the other nodes linked.

    pairs are the links of the lists, full the nodes whose lists may lack some. A component is cut in
    blocks, and every ordered pair of blocks is a group of its own; blocks are small where that
    spreads a component over tasks, and at most rule.most_block nodes where it is large.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = staged(named.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    asking = named.join(sizes, "component").join(full.select(F.col("nid").alias("node"), F.lit(True).alias("full")), "node", "left")
    asking = staged(asking.select("node", "component", "size", (F.coalesce("full", F.lit(False)) | (F.col("size") <= rule.whole)).alias("asks")), "asking")
    weight = nodes.select("nid", "weight")
    lists = pairs.select(F.col("a").alias("node"), F.col("b").alias("nid")).unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("nid")))
    lists = lists.join(asking.where("not asks").select("node"), "node", "left_semi").join(weight, "nid")
    listed = lists.groupBy(F.col("node").alias("nid")).agg(F.sum("weight").alias("links"), F.count(F.lit(1)).alias("near"))

    some = asking.join(asking.where("asks").select("component").distinct(), "component", "left_semi")
    rows = nodes.join(some.withColumnRenamed("node", "nid"), "nid")
    spread = rule.most_block // (rule.block // 4)
    number = F.greatest(F.least(F.ceil(F.col("size") * 4 / rule.block), F.lit(spread)), F.ceil(F.col("size") / rule.most_block))
    rows = rows.withColumn("nb", number).withColumn("mine", F.pmod(F.xxhash64("nid"), F.col("nb")))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)))
    asks = pairs.where("asks").select("component", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(True).alias("ask"), "nid", "weight", "unit")
    members = pairs.select("component", F.col("other").alias("i"), F.col("mine").alias("j"), F.lit(False).alias("ask"), "nid", "weight", "unit")
    keyed = asks.unionAll(members).withColumn("key", F.concat_ws(":", "component", "i", "j"))

    def one(held: pd.DataFrame) -> pd.DataFrame:
        q, m = held[held["ask"]], held[~held["ask"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"nid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "near": np.zeros(0, np.int64)})
        v, weight, out, near = _matrix(m["unit"], np.float64), m["weight"].to_numpy(np.float64), [], []
        for at in range(0, len(q), 512):
            part = q.iloc[at : at + 512]
            hit = (_matrix(part["unit"], np.float64) @ v.T) >= rule.threshold
            hit &= part["nid"].to_numpy()[:, None] != m["nid"].to_numpy()[None]
            out.append(hit @ weight)
            near.append(hit.sum(1))
        return pd.DataFrame({"nid": q["nid"].to_numpy(), "links": np.concatenate(out).astype(np.int64), "near": np.concatenate(near).astype(np.int64)})

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            last = held["key"] == held["key"].iloc[-1]
            done, held = held[~last], held[last].reset_index(drop=True)
            for _, group in done.groupby("key", sort=False):
                yield one(group)
        if held is not None and len(held):
            yield one(held)

    got = keyed.select("key", "ask", "nid", "weight", "unit").repartition(parts, "key").sortWithinPartitions("key").mapInPandas(run, "nid long, links long, near long")
    return got.groupBy("nid").agg(F.sum("links").alias("links"), F.sum("near").alias("near")).unionAll(listed)


def audited(nodes: DataFrame, links: DataFrame, rule: Descent, count: int, seed: int) -> float:
    """Mean share of linked nodes found, over the nodes with links of a sample of distinct vectors.

    The sample starts with rule.audit nodes and takes four times as many until rule.audit / 8 of
    them have links, at most 64 * rule.audit: links that are rarer than that are not audited.
    """
    size, linked, total, at = rule.audit, 0, 0.0, 0
    ranked = nodes.select("nid", "unit").orderBy(F.xxhash64("nid", F.lit(seed)), "nid")
    while True:
        for asked in _runs(ranked, at, min(size, count), 4 * rule.audit):
            for _, own in asked.groupby(asked["unit"].map(len)):
                n, share = _audit(nodes, links, rule, own)
                linked, total = linked + n, total + share
        at = min(size, count)
        if linked >= rule.audit // 8 or at >= min(count, 64 * rule.audit):
            return total / linked if linked else 1.0
        size *= 4


def _runs(ranked: DataFrame, start: int, end: int, most: int) -> Iterator[pd.DataFrame]:
    """Rows start to end of ranked, at most most at a time."""
    for at in range(start, end, most):
        yield ranked.offset(at).limit(min(most, end - at)).toPandas()


def _audit(nodes: DataFrame, links: DataFrame, rule: Descent, asked: pd.DataFrame) -> tuple[int, float]:
    """Of nodes of one length: how many have links, and the sum of the shares found."""
    shared = nodes.sparkSession.sparkContext.broadcast((asked["nid"].to_numpy(), _matrix(asked["unit"], np.float64)))  # bounded by rule.audit

    def run(frames):
        ids, q = shared.value
        truth = np.zeros(len(ids), np.int64)
        for frame in frames:
            frame = frame[frame["unit"].map(len) == q.shape[1] * 8]
            for at in range(0, len(frame), 2048):
                part = frame.iloc[at : at + 2048]
                hit = (q @ _matrix(part["unit"], np.float64).T) >= rule.threshold
                truth += (hit & (ids[:, None] != part["nid"].to_numpy()[None])).sum(1)
        yield pd.DataFrame({"nid": ids, "truth": truth})[truth > 0]

    truth = nodes.select("nid", "unit").mapInPandas(run, "nid long, truth long").groupBy("nid").agg(F.sum("truth").alias("truth"))
    found = F.least(F.lit(1.0), F.coalesce("near", F.lit(0)) / F.col("truth"))
    row = truth.join(links, "nid", "left").agg(F.count(F.lit(1)), F.sum(found)).first()
    shared.unpersist()
    return row[0], row[1] or 0.0


def near_duplicates(df: DataFrame, rule: Descent | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component (smallest id reachable), one row per row of df."""
    rule = rule or Descent()
    floor = max(math.cos(2 * math.acos(rule.threshold)), 0.0)
    rows = staged(prepared(df, id_col, vec_col), "vectors")
    nodes = rows.where("twin is not null").groupBy("twin").agg(F.min("nid").alias("nid"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"), F.min("id").alias("id"))
    nodes = staged(nodes.withColumn("comp", F.col("nid")), "nodes")
    count = nodes.count()
    graph, seed, recall = None, 0, 0.0
    passes = math.ceil(tables_for(rule, bits_for(rule, count)) / rule.tables)
    for attempt in range(rule.attempts):
        for seed in range(seed, passes << attempt):
            more = first_graph(nodes, rule, count, floor, seed)
            graph = more if graph is None else staged(_top(graph.unionAll(more), rule.k), "graph")
        seed = passes << attempt
        for _ in range(rule.rounds):
            graph = refine(graph, nodes, rule, floor)
        pairs = staged(confirmed(graph, nodes, rule.threshold), "pairs")
        named = staged(components(pairs), "named")
        named = widened(graph, nodes, named, rule, count, floor, list(range(seed)))
        links = staged(counted(nodes, named, pairs, saturated(graph, rule), rule), "links")
        recall = audited(nodes, links, rule, count, attempt)
        if recall >= rule.recall:
            break
    else:
        raise RuntimeError(f"recall of links {recall:.4f} is under {rule.recall} after {seed * rule.tables} tables")
    low = named.join(nodes.select(F.col("nid").alias("node"), "id"), "node").groupBy("component").agg(F.min("id").alias("name"))
    tagged = nodes.select("nid", "twin", "weight", F.col("id").alias("own")).join(links.select("nid", "links"), "nid", "left").join(named.withColumnRenamed("node", "nid"), "nid", "left").join(low, "component", "left")
    tagged = tagged.select("twin", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("name", "own").alias("component"))
    out = rows.select("id", "twin").join(tagged, "twin", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: links at cosine 0.9 and their components, over all embeddings."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return got.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
