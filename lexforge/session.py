"""Session construction with the settings every operator here assumes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexforge", master: str | None = None, **conf: str) -> SparkSession:
    """A SparkSession in UTC with adaptive execution and Arrow transfer on.

    Extra settings are given as keyword arguments with dots written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("MASTER"):
        builder = builder.master(master or "local[*]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table; only Spark touches the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='lexforge-')}"
        shared_folder.own = root
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def text_runs(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts hold about most bytes, one row at least; an Arrow batch counts rows only."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df written once as a compressed table in the shared folder and read back, for results too large to cut() as they are.

    Tables are taken away when the application ends, since results may be read late.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_take_away)
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _take_away() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        for path in _WRITTEN:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may already be gone at exit
        return
    _WRITTEN.clear()
