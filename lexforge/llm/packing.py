"""Packing token sequences by cutting-stock column generation.

Documents become ids of the word-end BPE followed by id 2; null text counts as empty and is one
token. Lengths are rounded up to units, and a linear program over patterns (how many documents of
each unit length fill a sequence) is solved by column generation: an unbounded-knapsack dynamic
program prices new columns by the duals. Rounded-down pattern counts are assigned to documents
ranked within their unit length; what rounding leaves over is placed by first fit decreasing.
The gaps that rounding up leaves are then filled exactly by cutting the longest documents, which
are laid end to end against the gaps laid end to end; what remains of them fills whole sequences
and, at the very end, powers of two, which need no padding.

The driver holds the length histogram (at most capacity+1 rows), the patterns and a few sums.
Ranks and prefix sums go level by level (within a task's output, then over groups of tasks), so no
task orders more than one group. Ties of length go by task and row. Repeated rows are documents of
their own; columns other than id and text are not read, and ids of any type, null included, come
back as they were. A text of any length is one document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import map_batches, map_tasks, running, staged, text_of


@dataclass(frozen=True)
class Plan:
    """Patterns (units of each length per sequence) with how many sequences each is used for."""

    patterns: np.ndarray  # patterns x classes
    counts: np.ndarray


def price(duals: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Best value and pattern of the unbounded knapsack; duals[c-1] is the worth of length c."""
    best, take = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for room in range(1, units + 1):
        value = duals[:room] + best[room - 1 :: -1][:room]
        c = int(np.argmax(value))
        if value[c] > best[room - 1] + 1e-12:
            best[room], take[room] = value[c], c + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(units, dtype=np.int64), units
    while room:
        if take[room]:
            pattern[take[room] - 1] += 1
            room -= take[room]
        else:
            room -= 1
    return float(best[units]), pattern


def solve(demand: np.ndarray, tolerance: float = 1e-6, rounds: int = 4000) -> Plan:
    """Column generation for demand[c-1] documents of c units in sequences of len(demand) units."""
    units = len(demand)
    rows = np.flatnonzero(demand)
    m = len(rows)
    if not m:
        return Plan(np.zeros((0, units), np.int64), np.zeros(0, np.int64))
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = units // (rows + 1)
    d = demand[rows].astype(float)
    x = d / np.diag(basis)
    for _ in range(rounds):
        duals = np.zeros(units)
        duals[rows] = np.maximum(np.linalg.solve(basis.T, np.ones(m)), 0)
        value, pattern = price(duals, units)
        if value <= 1 + tolerance:
            break
        column = np.linalg.solve(basis, pattern[rows].astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, x / column, np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        step = max(float(ratio[leaves]), 0.0)
        x = x - step * column
        x[leaves] = step
        basis[:, leaves] = pattern[rows]
    whole = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    patterns = np.zeros((m, units), dtype=np.int64)
    patterns[:, rows] = np.rint(basis.T).astype(np.int64)
    left = demand - patterns.T @ whole
    while (left < 0).any():  # floating error only: give back sequences until no length is overdrawn
        c = int(np.argmin(left))
        j = int(np.argmax((patterns[:, c] > 0) * whole))
        whole[j] -= 1
        left = demand - patterns.T @ whole
    used = whole > 0
    extra = first_fit(left)
    return Plan(np.concatenate([patterns[used], extra]), np.concatenate([whole[used], np.ones(len(extra), np.int64)]))


def first_fit(left: np.ndarray) -> np.ndarray:
    """Patterns that hold the few documents left by rounding, longest first."""
    units, bins, room = len(left), [], []
    for c in range(units, 0, -1):
        for _ in range(int(left[c - 1])):
            at = next((i for i, r in enumerate(room) if r >= c), None)
            if at is None:
                bins.append(np.zeros(units, dtype=np.int64))
                room.append(units)
                at = len(bins) - 1
            bins[at][c - 1] += 1
            room[at] -= c
    return np.array(bins, dtype=np.int64).reshape(-1, units)


def tokenized(df: DataFrame, id_col: str, text_col: str, unit: int, path: str | None = None) -> DataFrame:
    """id, part, at, cls, rk, n, crc, ids: rk ranks the rows of a unit length within their task."""
    end = np.array([2], dtype="<u2").tobytes()

    def start():
        from lexforge.llm.wordbpe import WordBpe

        coder, part, at = WordBpe(path), TaskContext.get().partitionId(), 0
        ranks: dict[int, int] = {}

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal at
            rows = []
            for b in coder.encode([text_of(t) for t in frame["t"]]):
                b += end
                n = len(b) // 2
                cls = -(-n // unit)
                rk = ranks.get(cls, 0)
                ranks[cls] = rk + 1
                rows.append((part, at, cls, rk, n, zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()), b))
                at += 1
            return pd.DataFrame(rows, columns=["part", "at", "cls", "rk", "n", "crc", "ids"])

        return run

    shape = "part long, at long, cls long, rk long, n long, crc long, ids binary"
    return map_tasks(df.select(df[id_col].alias("id"), df[text_col].alias("t")), start, shape, carry=["id"])


def _filler_threshold(hist: dict[int, int], sums: dict[int, int], capacity: int, unit: int) -> int:
    """Documents longer than this are cut to fill the gaps of the rest; whole unit lengths only."""
    docs = sum(hist.values()) - hist.get(capacity + 1, 0)
    tokens, threshold = sums.get(capacity + 1, 0), capacity
    while threshold > 0 and tokens < 0.6 * unit * docs + 4 * capacity:
        tokens += sums.get(threshold, 0)
        docs -= hist.get(threshold, 0)
        threshold -= 1
    return threshold - threshold % unit


def pack(df: DataFrame, capacity: int = 4096, unit: int = 16, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    spark = df.sparkSession
    docs = staged(tokenized(df, id_col, text_col, unit, path), "tokens")
    rows = docs.groupBy(F.least("n", F.lit(capacity + 1)).alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).collect()
    hist, sums = {r["k"]: r["c"] for r in rows}, {r["k"]: r["s"] for r in rows}
    threshold = _filler_threshold(hist, sums, capacity, unit)
    demand = np.zeros(capacity // unit, dtype=np.int64)
    for n, c in hist.items():
        if n <= threshold:
            demand[-(-n // unit) - 1] += c
    plan = solve(demand)
    first = np.concatenate([[0], np.cumsum(plan.counts)]).astype(np.int64)
    n_patterned = int(first[-1])

    # ranked documents to slots: rank within the unit length -> pattern, sequence, slot
    small = docs.where(F.col("n") <= threshold).drop("ids")
    # a unit length and a task make one part; its base within the length is the running sum less the length's own start
    counts = staged(small.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("c")), "counts")
    tasks = counts.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    bases = running(counts.select((F.col("cls") * tasks + F.col("part")).alias("part"), "c"), "c")
    bases = bases.select(F.floor(F.col("part") / tasks).alias("cls"), F.pmod("part", F.lit(tasks)).alias("part"), "base")
    before = np.concatenate([[0], np.cumsum(demand)])[:-1]
    ahead = spark.createDataFrame([(c + 1, int(b)) for c, b in enumerate(before)], "cls long, ahead long")  # one row per unit length
    bases = bases.join(F.broadcast(ahead), "cls").select("cls", "part", (F.col("base") - F.col("ahead")).alias("base"))
    ranked = small.join(bases, ["cls", "part"]).withColumn("rank", F.col("rk") + F.col("base"))
    shared = spark.sparkContext.broadcast((plan.patterns, plan.counts, first))  # bounded by the unit lengths

    @F.pandas_udf("long")
    def sequence_of(cls: pd.Series, rank: pd.Series) -> pd.Series:
        patterns, counts, starts = shared.value
        out = np.empty(len(cls), dtype=np.int64)
        for c in np.unique(cls):
            on = np.flatnonzero(cls.to_numpy() == c)
            ends = np.cumsum(patterns[:, c - 1] * counts)
            r = rank.to_numpy()[on]
            j = np.searchsorted(ends, r, "right")
            k = r - (ends[j] - patterns[j, c - 1] * counts[j])
            out[on] = starts[j] + k % counts[j]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence_of("cls", "rank"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("n"), "part", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    whole = placed.select("id", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    whole = staged(whole, "whole")

    total = sum(s for k, s in sums.items() if k > threshold)
    if total:
        out = whole.unionAll(_cut_fillers(docs.where(F.col("n") > threshold), whole, capacity, n_patterned, total))
    else:
        out = whole
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _cut_fillers(long_docs: DataFrame, whole: DataFrame, capacity: int, n_patterned: int, total: int, cell: int = 32_768) -> DataFrame:
    """Pieces of the long documents: first into the gaps, then into sequences of their own."""
    group = 4096
    gaps = whole.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("gap", capacity - F.col("used")).where("gap > 0")
    gaps = gaps.withColumn("part", F.floor(F.col("sequence_id") / group))
    gap_base = running(gaps.groupBy("part").agg(F.sum("gap").alias("g")), "g")
    inside = Window.partitionBy("part").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    line = gaps.withColumn("at", F.coalesce(F.sum("gap").over(inside), F.lit(0))).join(gap_base, "part")
    line = staged(line.select("sequence_id", F.col("used").alias("offset"), (F.col("at") + F.col("base")).alias("x0"), (F.col("at") + F.col("base") + F.col("gap")).alias("x1")), "gaps")
    gap_total = line.agg(F.coalesce(F.max("x1"), F.lit(0))).first()[0]

    doc_base = running(long_docs.groupBy("part").agg(F.sum("n").alias("s")), "s")
    ahead = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    keys = long_docs.select("part", "at", "n").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(doc_base, "part")
    keys = keys.select("part", "at", "n", (F.col("before") + F.col("base")).alias("f0"), (F.col("before") + F.col("base") + F.col("n")).alias("f1"))

    # whole sequences after the gaps, then powers of two
    rest = max(total - gap_total, 0)
    full = rest // capacity
    tail, bounds, x, seq = rest - full * capacity, [], gap_total + full * capacity, n_patterned + full
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            bounds.append((seq, 0, x, x + (1 << bit)))
            x, seq = x + (1 << bit), seq + 1
    spark = whole.sparkSession
    tails = spark.createDataFrame(bounds or [(0, 0, 0, 0)], "sequence_id long, offset long, x0 long, x1 long").where("x1 > x0")
    slots = line.unionAll(tails)

    def celled(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))))

    near = celled(keys, "f0", "f1").join(celled(slots, "x0", "x1"), "cell")
    near = near.withColumn("lo", F.greatest("f0", "x0", F.col("cell") * cell)).withColumn("hi", F.least("f1", "x1", (F.col("cell") + 1) * cell)).where("lo < hi")
    filled = near.select("part", "at", "f0", "lo", "hi", "sequence_id", (F.col("offset") + F.col("lo") - F.col("x0")).alias("offset"))
    g0, g1 = gap_total, gap_total + full * capacity
    own = keys.withColumn("a", F.greatest("f0", F.lit(g0))).withColumn("b", F.least("f1", F.lit(g1))).where("a < b")
    own = own.withColumn("q", F.explode(F.sequence(F.floor((F.col("a") - g0) / capacity), F.floor((F.col("b") - 1 - g0) / capacity))))
    own = own.withColumn("lo", F.greatest("a", F.col("q") * capacity + g0)).withColumn("hi", F.least("b", (F.col("q") + 1) * capacity + g0))
    own = own.select("part", "at", "f0", "lo", "hi", (F.col("q") + n_patterned).alias("sequence_id"), (F.col("lo") - g0 - F.col("q") * capacity).alias("offset"))
    cuts = filled.unionAll(own).groupBy("part", "at").agg(F.collect_list(F.struct((F.col("lo") - F.col("f0")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"), "sequence_id", "offset")).alias("cuts"))

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, pieces in zip(frame["ids"], frame["cuts"], strict=True):
            wide = np.frombuffer(ids, "<u2").astype("<u4")
            out.append([{**c, "ids_crc32": zlib.crc32(wide[c["start"] : c["start"] + c["length"]].tobytes())} for c in pieces])
        return pd.DataFrame({"pieces": out})

    shape = "pieces array<struct<start:long,length:long,ids_crc32:long,sequence_id:long,offset:long>>"
    got = map_batches(long_docs.select("part", "at", "id", "n", "ids").join(cuts, ["part", "at"]).select("id", "n", "ids", "cuts"), cut, shape, carry=["id", "n"])
    got = got.select("id", "n", F.explode("pieces").alias("x"))
    return got.select("id", "x.start", "x.length", "x.ids_crc32", F.col("n").alias("doc_tokens"), "x.sequence_id", "x.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: pieces of all documents in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces of docs."""
    return pack(docs)
