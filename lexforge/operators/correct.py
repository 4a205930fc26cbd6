"""Dictionary corrections of texts and learned fixes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexforge.functions.normalize import words
from lexforge.session import cut, text_runs


def apply_dictionary(df: DataFrame, fixes: DataFrame, key: str, text: str, most_broadcast: int = 200_000) -> DataFrame:
    """key, corrected, n_fixed: white-space words replaced by fixes(word, correction), any case.

    A dictionary of up to most_broadcast words goes to every task and texts stay where they are;
    a larger one meets the words of the texts by a join, and rows come back by key. A word with
    several corrections takes the smallest.
    """
    known = cut(fixes.groupBy(F.lower("word").alias("k")).agg(F.min("correction").alias("correction")))
    if known.count() <= most_broadcast:
        shared = df.sparkSession.sparkContext.broadcast({r["k"]: r["correction"] for r in known.collect()})

        def replaced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A dictionary look-up per word has no built-in form: a map column is searched from end to end."""
            table = shared.value
            for piece in (p for batch in batches for p in text_runs(batch, "t")):
                out = []
                for t in piece.column("t"):
                    w = re.findall(r"[^ \t\n\x0B\f\r]+", t.as_py() or "")
                    new = [table.get(x.lower()) for x in w]
                    out.append((" ".join(x if n is None else n for x, n in zip(w, new, strict=True)), sum(n is not None for n in new)))
                yield pa.RecordBatch.from_arrays([piece.column("k"), pa.array([c for c, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["k", "corrected", "n_fixed"])

        shape = StructType([StructField("k", df.schema[key].dataType), StructField("corrected", StringType()), StructField("n_fixed", LongType())])
        got = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(replaced, shape)
        return got.where("corrected <> ''").select(F.col("k").alias(key), "corrected", "n_fixed")
    tokens = df.select(key, F.posexplode(words(F.col(text))).alias("i", "w"))
    found = tokens.withColumn("k", F.lower("w")).join(known, "k", "left")
    sorted_ = F.array_sort(F.collect_list(F.struct("i", F.coalesce("correction", "w").alias("w"))))
    return found.groupBy(key).agg(F.array_join(F.transform(sorted_, lambda x: x.w), " ").alias("corrected"), F.count("correction").alias("n_fixed"))


def learned_fixes(votes: DataFrame, least: int = 2) -> DataFrame:
    """word, correction: the most frequent change of each word, ties to the smallest, with enough votes."""
    counts = votes.groupBy(F.lower("original").alias("word"), F.col("corrected").alias("correction")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "correction"))
    return counts.withColumn("r", rank).where("r = 1").select("word", "correction", "n")
