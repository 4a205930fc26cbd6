"""Shared pieces of the training-data operators: staging, spans, digests, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

_STAGED: dict[str, None] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode, where all tasks see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_root, "own", None) or f"file://{tempfile.mkdtemp(prefix='lexforge-')}"
        shared_root.own = root
    return root.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written once as Parquet in the shared folder and read back; this cuts lineage.

    Files stay until the application ends, since results may be read lazily, or until dropped().
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED[path] = None
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Removes staged tables that nothing reads any more; a round's table goes when the next is written."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path in _STAGED:
            _delete(table.sparkSession, path)
            del _STAGED[path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_staged() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in list(_STAGED):
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may already be gone at exit
        return


def slices(batch: pa.RecordBatch, bytes_: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """batch in row runs whose texts (column t, if any) hold about bytes_ bytes, one row at least."""
    if "t" not in batch.schema.names or not batch.num_rows:
        yield batch
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + bytes_, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_tasks(df: DataFrame, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """df through the function that start makes once per task, some texts at a time.

    An Arrow batch goes in slices, so memory is bounded. Columns of carry stay in Arrow beside what
    the function makes of the others (and of t, if that is carried), which then gives one row per
    row: a nullable long, a NaN or an old date passes unchanged, which it would not through pandas.
    """
    carry = list(carry)
    made = StructType.fromDDL(schema)
    shape = to_arrow_schema(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            for piece in slices(batch):
                if piece.num_rows:
                    rest = [c for c in piece.schema.names if c not in carry or c == "t"]
                    got = fn(piece.select(rest).to_pandas())
                    arrays = [piece.column(c) for c in carry] + [pa.Array.from_pandas(got[f.name], type=f.type) for f in shape]
                    yield pa.RecordBatch.from_arrays(arrays, [*carry, *shape.names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in carry), *made]))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, carry: Sequence[str] = ()) -> DataFrame:
    """map_tasks with one function for all tasks."""
    return map_tasks(df, lambda: fn, schema, carry)


def span_text(spans: Column) -> Column:
    """kind:start:end of array<struct<start,end,kind,...>>, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def running(sizes: DataFrame, size: str, group: int = 4096) -> DataFrame:
    """(part, base): the sum of size over smaller parts, for rows (part, size) with one row per part.

    Sums of groups of parts are summed in the same way, level by level, so no task orders more
    than group rows however many parts there are.
    """
    parts = staged(sizes.select("part", F.col(size).alias("s"), F.floor(F.col("part") / group).alias("up")), "sums")
    ups = staged(parts.groupBy("up").agg(F.sum("s").alias("s")), "sums")
    if ups.count() > group:
        above = running(ups.select(F.col("up").alias("part"), "s"), "s", group)
        above = above.select(F.col("part").alias("up"), F.col("base").alias("ahead"))
    else:  # at most group rows
        rows = sorted((r["up"], r["s"]) for r in ups.collect())
        ahead = np.concatenate([[0], np.cumsum([s for _, s in rows])]).astype(np.int64)
        shape = StructType([StructField("up", LongType()), StructField("ahead", LongType())])
        above = sizes.sparkSession.createDataFrame([(u, int(a)) for (u, _), a in zip(rows, ahead)], shape)
    inside = Window.partitionBy("up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("in", F.coalesce(F.sum("s").over(inside), F.lit(0))).join(above, "up").select("part", (F.col("in") + F.col("ahead")).alias("base"))


def text_of(value: object) -> str:
    """The text, where null counts as empty."""
    return value if isinstance(value, str) else ""


def mix64(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splitmix64 finaliser over uint64 values."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over edges a-b, by pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b = a[live], b[live]
        low, high = np.minimum(ra[live], rb[live]), np.maximum(ra[live], rb[live])
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return root


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Alternating large-star and small-star steps over the edge list; each step hangs nodes on
    smaller ones, so long chains shrink geometrically. A node of huge degree is first reduced
    to one minimum by partial aggregation and the star is rebuilt by a join that Spark may
    split, so no group of neighbours is ever gathered. Lineage is cut every round by a written
    table. Raises if rounds do not suffice.
    """
    e = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    previous = None
    for _ in range(rounds):
        # large star: every neighbour larger than the node hangs on the smallest of the neighbourhood
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, e = e, staged(small.where("u <> v").distinct(), "edges")
        dropped(last)
        now = e.agg(F.count(F.lit(1)), F.expr("sum(cast(u as decimal(38,0)))"), F.expr("sum(cast(v as decimal(38,0)))")).first()
        if tuple(now) == previous:
            leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaves.unionAll(tops)
        previous = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
