"""Embedding whitening by a tall-skinny QR: centred rows, a QR per task, a tree of R factors, an SVD.

Every vector's entries c become integers floor(64 * c) + 1000000; their sums per dimension are exact
(64-bit halves, added without a limit), so centred rows n * x - S are exact integers before they are
divided by n. Each task reduces its rows to one triangular factor, factors are stacked and reduced
sixteen at a time in Spark until one is left, and the right singular vectors of that one are the
components; no covariance is formed. The identity error is measured on the whitened rows themselves
by merging counts, means and centred products of tasks in the same tree.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, also entries that
leave the 64-bit range when scaled by 64. If lengths differ, those of the most frequent length (the
larger of equals) are kept. Repeated rows each count; null ids come back as they were. Components of
no variance (a singular value under 1e-10 of the largest) cannot be whitened and give no rows, so a
table of equal vectors or an empty one gives none. A deviation beyond 64 bits is null. Memory of a
task is an Arrow batch and a square factor of the dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexforge.llm.common import dropped, staged

SCALE, SHIFT = 64, 1_000_000
FAN_IN = 16
FLAT = 1e-10


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and v, the vectors as doubles, of the rows that take part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(2**62 // SCALE)))
    rows = df.select(F.col(key), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    return rows.where(F.size("v") == lengths[0]["d"]) if len(lengths) > 1 else rows


def integers(v: pa.ListArray) -> np.ndarray:
    """The rows of a list column as scaled whole numbers."""
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit where that holds every value, Python's whole numbers otherwise."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) * 2
    return x * n - np.array(sums, dtype=np.int64) if most < 2**62 else x.astype(object) * n - np.array(sums, dtype=object)


def _partials(rows: DataFrame, start: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """(slot, m, a): one partial result per task that has rows, as the two functions of start make it.

    The first takes an Arrow batch, the second gives (number of rows, matrix).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, result = start()
        for batch in batches:
            if batch.num_rows:
                add(batch)
        m, a = result()
        if m:
            yield pa.RecordBatch.from_pydict({"slot": [TaskContext.get().partitionId()], "m": [m], "a": [a.ravel().tolist()]}, schema=pa.schema([("slot", pa.int64()), ("m", pa.int64()), ("a", pa.list_(pa.float64()))]))

    return rows.mapInArrow(run, "slot long, m long, a array<double>")


def tree(parts: DataFrame, merge: Callable[[list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The one result that is left when partials (slot, m, a) are merged FAN_IN at a time, level by level."""

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        m, a = merge([(m, np.asarray(a)) for m, a in zip(frame.sort_values("slot")["m"], frame.sort_values("slot")["a"])])
        return pd.DataFrame({"slot": [frame["slot"].min() // FAN_IN], "m": [m], "a": [a.ravel()]})

    level = staged(parts, "factors")
    while level.count() > 1:
        last, level = level, staged(level.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInPandas(merged, "slot long, m long, a array<double>"), "factors")
        dropped(last)
    top = level.first()
    dropped(level)
    return (top["m"], np.asarray(top["a"])) if top else (0, np.zeros(0))


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sums of every dimension; halves of 32 bits are summed apart, so nothing overflows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("v"))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "high": [high], "low": [low]})

    parts = rows.select("v").mapInArrow(run, "n long, high array<long>, low array<long>")
    wide = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c.split(".")[-1])
    got = wide.groupBy("i").agg(F.sum("n").alias("n"), total("s.high"), total("s.low")).orderBy("i").collect()  # a row per dimension
    return (got[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in got]) if got else (0, [])


def triangle(a: np.ndarray) -> np.ndarray:
    """R of a's QR, with zero rows below where a has fewer rows than columns."""
    r = np.linalg.qr(a, mode="r")
    return r if len(r) == a.shape[1] else np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])


def components_of(rows: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvectors as columns, eigenvalues, trace) of the covariance of the integer rows, largest first."""
    d = len(sums)

    def start():
        state = {"m": 0, "r": np.zeros((0, d))}

        def add(batch):
            rows = np.asarray(centred(integers(batch.column("v")), n, sums) / n, dtype=np.float64)
            state["m"] += len(rows)
            state["r"] = triangle(np.vstack([state["r"], rows]))

        return add, lambda: (state["m"], state["r"])

    def merge(parts):
        return sum(m for m, _ in parts), triangle(np.vstack([a.reshape(d, d) for _, a in parts]))

    _, r = tree(_partials(rows.select("v"), start), merge)
    _, s, vt = np.linalg.svd(r.reshape(d, d))
    kept = int((s > FLAT * s[0]).sum()) if s[0] > 0 else 0
    vectors = vt[: min(most, kept)]
    largest = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]  # largest entry positive
    values = s**2 / n
    return vectors.T, values[: len(vectors)], float(values.sum())


def identity_error(rows: DataFrame, n: int, sums: list[int], matrix: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance, centred on their own mean, less the identity."""
    k = matrix.shape[1]

    def join(one, two):
        (m, mean, prod), (m2, mean2, prod2) = one, two
        shift = mean2 - mean
        return m + m2, mean + shift * (m2 / (m + m2)), prod + prod2 + np.outer(shift, shift) * (m * m2 / (m + m2))

    def start():
        state = [(0, np.zeros(k), np.zeros((k, k)))]

        def add(batch):
            w = np.asarray(centred(integers(batch.column("v")), n, sums) / n, dtype=np.float64) @ matrix
            mean = w.mean(axis=0)
            state[0] = join(state[0], (len(w), mean, (w - mean).T @ (w - mean)))

        return add, lambda: (state[0][0], np.vstack([state[0][1], state[0][2]]))

    def merge(parts):
        all_ = (0, np.zeros(k), np.zeros((k, k)))
        for m, a in parts:
            a = a.reshape(k + 1, k)
            all_ = join(all_, (m, a[0], a[1:]))
        return all_[0], np.vstack([all_[1], all_[2]])

    m, a = tree(_partials(rows.select("v"), start), merge)
    return float(np.abs(a.reshape(k + 1, k)[1:] / m - np.eye(k)).max())


def deviations(z: np.ndarray) -> pa.Array:
    """Sums of squares of whole numbers, exactly; null beyond 64 bits."""
    if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 2**63:
        return pa.array((z * z).sum(axis=1), pa.int64())
    sums = (z.astype(object) ** 2).sum(axis=1)
    return pa.array([int(s) if s < 2**63 else None for s in sums], pa.int64())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = usable(df, key, vector)
    id_field = StructField(key, rows.schema[key].dataType)
    made = StructType([id_field, *StructType.fromDDL("deviation long, w array<double>")])
    n, sums = exact_sums(rows)
    vectors, values, trace = components_of(rows, n, sums, most) if n else (np.zeros((0, 0)), np.zeros(0), 0.0)
    if not len(values):
        shape = StructType([id_field, *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
        return df.sparkSession.createDataFrame([], shape)
    matrix = vectors / np.sqrt(values)
    error = identity_error(rows, n, sums, matrix)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = centred(integers(batch.column("v")), n, sums)
                w = np.asarray(z / n, dtype=np.float64) @ matrix
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(key), deviations(z), lists], [key, "deviation", "w"])

    share = F.element_at(F.array(*(F.lit(float(e / trace)) for e in values)), F.col("c") + 1)
    long_ = rows.mapInArrow(project, made).select(key, "deviation", F.posexplode("w").alias("c", "whitened"))
    return long_.select(key, (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened on up to 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
