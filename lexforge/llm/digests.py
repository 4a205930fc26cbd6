"""Document fingerprints: a digest of bucket quartiles that stays close under edits.

Every three neighbouring bytes of a text's UTF-8 are hashed to one of 512 buckets and counted. A
bucket's code says in which quarter of the text's own bucket counts it lies (2 bits), and a leading
byte holds the length on a scale of tenths. Two digests differ by the mean distance of their codes,
as a share of what two unrelated texts with the same codes would have, plus a bounded term for
unlike lengths; likeness is one less that difference, held between 0 and 1. Equal texts have equal
digests and likeness 1.

Null and empty texts are equal: length zero, all codes zero, unlike every text with a triplet. Texts
of one or two bytes have no triplet and differ by length only. The next document is the one that
follows by descending id, after the last the first; rows of one id follow each other by their texts,
and a null id comes after all others (like the least 64-bit number). A table of one row is followed
by itself; an empty table gives no rows. Other columns are not looked at. A text is read whatever
its length, a million bytes at a time.

Rows are dealt in ranges of ids that end at ids of the table, so a range's own last row finds its
follower in a copy of the next range's first row: texts are shuffled once and no row is looked up.
Rows that share one id are in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexforge.llm.common import mix64, slices, text_of

BUCKETS = 512
#: bytes that are hashed at a time, and texts whose counts are held at a time
PIECE, ROWS = 1 << 20, 1024
#: lengths that differ by this many tenths (a factor of three) are as unlike as lengths can be
FAR, LENGTH_SHARE = 12, 0.3
_TABLES = [(mix64(np.arange(256), seed) % BUCKETS).astype(np.uint16) for seed in (1, 2, 3)]
_STEPS = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))
_LEAST = -(2**63)


def triplet_counts(texts: list[bytes]) -> np.ndarray:
    """How often each bucket is hit by a triplet of each text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    all_ = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for at in range(0, max(0, len(all_) - 2), PIECE):
        b = all_[at : at + PIECE + 2]
        to = at + len(b) - 2
        low, high = np.searchsorted(ends, [at, to - 1], "right") + [0, 1]
        owner = np.repeat(np.arange(high - low), np.diff(np.clip(ends[low:high], at, to), prepend=at))
        hits = owner * BUCKETS + (_TABLES[0][b[:-2]] ^ _TABLES[1][b[1:-1]] ^ _TABLES[2][b[2:]])
        for back in (1, 2):  # a triplet that begins here would reach into the next text
            last = ends[low : high + 1] - back - at
            hits[last[(last >= 0) & (last < len(hits))]] = (high - low) * BUCKETS
        out[low:high] += np.bincount(hits, minlength=(high - low) * BUCKETS + 1)[:-1].reshape(-1, BUCKETS)
    return out


def codes(texts: list[bytes]) -> np.ndarray:
    """A row per text: its length's byte, then the quartile codes of its buckets."""
    out = np.empty((len(texts), BUCKETS + 1), dtype=np.uint8)
    for at in range(0, len(texts), ROWS):
        part = texts[at : at + ROWS]
        counts = triplet_counts(part)
        ranks = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
        quarters = np.partition(counts, ranks, axis=1)[:, ranks]
        out[at : at + ROWS, 1:] = sum((counts > quarters[:, i : i + 1]).astype(np.uint8) for i in range(3))
        out[at : at + ROWS, 0] = np.minimum(255, np.round(np.log1p([len(t) for t in part]) / np.log(1.1)))
    return out


def written(rows: np.ndarray) -> list[str]:
    """Digests in hexadecimal: the length's byte, then four codes a byte."""
    four = rows[:, 1:].reshape(len(rows), -1, 4)
    packed = (four << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=2).astype(np.uint8)
    return [bytes(r).hex() for r in np.hstack([rows[:, :1], packed])]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the bounded difference of the digests in the same rows of a and b."""
    x, y = a[:, 1:].astype(np.int64), b[:, 1:].astype(np.int64)
    shares = lambda c: np.stack([(c == v).mean(axis=1) for v in range(4)], axis=1)
    chance = np.einsum("ri,ij,rj->r", shares(x), _STEPS, shares(y))
    seen = np.abs(x - y).mean(axis=1)
    body = np.divide(seen, chance, out=np.zeros(len(x)), where=seen > 0)
    length = np.minimum(1.0, np.abs(a[:, 0].astype(np.int64) - b[:, 0]) / FAR)
    return 1.0 - np.minimum(1.0, body + LENGTH_SHARE * length)


def range_ends(ids: DataFrame, parts: int) -> np.ndarray:
    """Rising ids of the table that cut it (column id, no nulls) into at most parts ranges of like size."""
    shares = [i / parts for i in range(1, parts)]
    splits = np.zeros(0, dtype=np.int64)
    if shares:
        splits = np.array(ids.agg(F.percentile_approx("id", shares, max(10_000, 8 * parts)).alias("s")).first()["s"] or [], dtype=np.int64)

    @F.pandas_udf("int")
    def rough(id_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, id_.to_numpy(np.int64)).astype(np.int32))

    tops = ids.groupBy(rough("id").alias("part")).agg(F.max("id").alias("top")).collect()  # at most one row per range
    return np.array(sorted({r["top"] for r in tops}), dtype=np.int64)


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """key, t, part, tail: rows by falling id in ranges; after a range's rows, with tail 1, those its last row is followed by."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.col(text).alias("t"), F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("id"))
    ends = range_ends(rows.select("id"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not len(ends):
        return None
    n = len(ends)

    @F.pandas_udf("part int, above int")
    def places(id_: pd.Series) -> pd.DataFrame:
        """The id's own range, and the range above, if it is the one that follows that range's last row."""
        ids = id_.to_numpy(np.int64)
        part = np.searchsorted(ends, ids)
        above = pd.array(np.where(ends[part] == ids, (part + 1) % n, -1), dtype="Int32")
        return pd.DataFrame({"part": part.astype(np.int32), "above": above})

    twice = F.filter(F.array(F.struct(F.col("p.part").alias("part"), F.lit(0).alias("tail")), F.struct(F.col("p.above").alias("part"), F.lit(1).alias("tail"))), lambda s: s.part >= 0)
    dealt = rows.withColumn("p", places("id")).select(key, "t", "id", F.explode(twice).alias("s")).select(key, "t", "id", "s.part", "s.tail")
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "tail", F.desc("id"), "t").select(key, "t", "part", "tail")


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    made = StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    shape = StructType([StructField(key, docs.schema[key].dataType), *made])
    ordered = in_order(docs, key, text)
    if ordered is None:
        return docs.sparkSession.createDataFrame([], shape)

    def compared(rows: pa.Table) -> pa.RecordBatch | None:
        """Every row of the table but the last beside the one after it; copies at the end of a range are not rows."""
        texts = [text_of(t) for t in rows.column("t").to_pylist()]
        own = np.flatnonzero(rows.column("tail").to_numpy()[:-1] == 0)
        if not len(own):
            return None
        edited, chars = [], []
        for i in own:
            n = len(texts[i])
            cut = n // 3
            edited.append((texts[i][: n - cut] + texts[i + 1][:cut]).encode())
            chars.append(n)
        base, changed = codes([t.encode() for t in texts]), codes(edited)
        columns = [chars, [hashlib.sha256(e).hexdigest() for e in edited], written(base[own]), written(changed), likeness(base[own], changed), likeness(base[own], base[own + 1])]
        return pa.RecordBatch.from_arrays([rows.column(key).combine_chunks().take(pa.array(own)), *map(pa.array, columns)], [key, *made.names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for its follower
        for batch in batches:
            for piece in slices(batch):
                if not piece.num_rows:
                    continue
                rows = pa.Table.from_batches([piece]) if held is None else pa.concat_tables([held, pa.Table.from_batches([piece])])
                got = compared(rows)
                held = pa.Table.from_pylist(rows.slice(rows.num_rows - 1).to_pylist(), schema=rows.schema)
                if got is not None:
                    yield got

    return ordered.mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each beside its edited text and the next document."""
    return followed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
