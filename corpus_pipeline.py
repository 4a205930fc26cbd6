"""Corpus cleaning in five stages, each one operator of lexforge.llm over all rows it is given.

toxicity: documents scored at or over the threshold go.
simhash_near_dedup: of each group of near copies the document with the smallest doc_id stays.
suffix_array_dedup: 200-byte strings that start anywhere else go from the texts; rows stay.
pii: personal data in the texts is replaced by the name of its kind; rows stay.
packing: what is left becomes pieces of sequences of at most 4096 tokens.

All stages but the last return the columns of documents. Rows with null texts pass as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import packing, pii, simhash, substrings, toxicity
from lexforge.llm.common import staged

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("simhash_near_dedup", simhash.keep_first),
    ("suffix_array_dedup", substrings.strip_repeats),
    ("pii", pii.redact),
    ("packing", packing.pack_documents),
]

#: Learned scores, hash-linked components and BPE ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
