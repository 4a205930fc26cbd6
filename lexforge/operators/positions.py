"""Full-text match over a positional inverted index: phrases, prefixes, NEAR, AND, OR, NOT, BM25.

The index has a row per term and segment (a run of documents of a bounded number of words) with the
term's places in each document, written in buckets of the term, so a search reads the buckets of its
own terms only (a prefix reads all buckets, with the beginning pushed down to the files). Each task
writes its own segments, a file per bucket, so a term that every document has is no single task's
work and nothing is shuffled but documents of which a part holds too many (see TASK); with spread, rows are dealt by term first, over spread tasks a term, which
leaves fewer files. A search then gathers, per document, the places of its own
terms and intersects them: a phrase is an intersection of shifted places.

Terms are runs of letters and digits, lower-cased; null texts are not in the index, texts without
terms count for the mean length only. Keys should be unique; rows of one key are read as one text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexforge.session import cut, shared_folder

#: words of a segment, unless one text has more
SEGMENT = 1_000_000
#: words that a task indexes, on average where they are dealt anew: it sorts their rows for the buckets
TASK = 8_000_000
_SPLIT = r"[^\p{L}\p{N}]+"


@dataclass
class Index:
    """segments: term, keys, lens, ends, at (arrays); n documents and mean length in terms.

    The i-th document of a row has the places of at up to the i-th of ends, from the one before.
    """

    segments: DataFrame
    key: str
    n: int
    mean: float


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), _SPLIT), lambda w: w != "")


def positional_index(docs: DataFrame, key: str, text: str, name: str | None = None, buckets: int = 16, spread: int | None = None) -> Index:
    """The index of docs, written in the shared folder as a bucketed table called name (a new name if none is given)."""
    spark = docs.sparkSession
    name = name or f"places_{uuid.uuid4().hex}"
    key_type = docs.schema[key].dataType
    ints = ArrayType(IntegerType())
    shape = StructType([StructField("term", StringType()), StructField("keys", ArrayType(key_type)), StructField("lens", ints), StructField("ends", ints), StructField("at", ints), StructField("part", IntegerType())])

    def segment(keys: pa.Array, lists: pa.ListArray, part: int) -> pa.RecordBatch:
        """A row per term of some documents: sorted by term, the places fall into runs per document."""
        words = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(lists)), sizes)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = words.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        code, doc, place = codes[order], doc[order], place[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
        starts = np.searchsorted(code[first], np.arange(len(words.dictionary) + 1))  # the first document of each term
        begins = np.append(first, len(doc))[starts]  # its first place
        listed = lambda offsets, values: pa.ListArray.from_arrays(offsets.astype(np.int32), values)
        ends = np.append(first[1:], len(doc)) - begins[code[first]]
        columns = [listed(starts, keys.take(pa.array(doc[first]))), listed(starts, pa.array(sizes[doc[first]].astype(np.int32))), listed(starts, pa.array(ends.astype(np.int32))), listed(begins, pa.array(place))]
        return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), *columns, pa.array(np.full(len(starts) - 1, part, dtype=np.int32))], ["term", "keys", "lens", "ends", "at", "part"])

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            ends = batch.column("w").offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SEGMENT, "right")) - 1)
                keys, lists = batch.column("key").slice(at, to - at), batch.column("w").slice(at, to - at)
                if len(lists.flatten()):
                    yield segment(keys, pa.ListArray.from_arrays(pa.array(ends[at : to + 1] - ends[at]), lists.flatten()), part % (spread or 1))
                at, part = to, part + 1

    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    each = texts.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(terms(F.col("text")))).alias("words"))
    size = each.agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("words").alias("most")).first()
    n, words = size["n"] or 0, size["words"] or 0
    if (size["most"] or 0) > TASK:
        texts = texts.repartition(words // TASK + 1, "key")
    rows = texts.select("key", terms(F.col("text")).alias("w")).mapInArrow(grouped, shape)
    rows = (rows.repartition("term", "part") if spread else rows).drop("part")
    path = f"{shared_folder(spark)}/tables/{name}"
    rows.write.bucketBy(buckets, "term").sortBy("term").option("path", path).option("compression", "zstd").mode("overwrite").saveAsTable(name)
    return Index(spark.table(name), key, n, words / n if n else 0.0)


_PIECE = re.compile(r'NEAR\(([^,()]+)(?:,\s*(\d+))?\)|"([^"]*)"(\*?)|(\S+)')


@dataclass
class Clause:
    """Terms that must stand side by side, or within gap terms of each other; the last may be a beginning."""

    words: list[str]
    prefix: bool = False
    gap: int | None = None


def parse_match(text: str) -> list[tuple[list[Clause], list[Clause]]]:
    """(wanted, unwanted) clauses of each alternative: side by side or AND binds before OR; NOT takes the next clause."""
    cut_ = lambda s: [w for w in re.split(r"[\W_]+", s.lower()) if w]
    groups, no = [([], [])], False
    for near, gap, phrase, star, word in _PIECE.findall(text):
        if word in ("AND", "OR", "NOT"):
            if word == "OR":
                groups.append(([], []))
            no = word == "NOT"
            continue
        if near:
            clause = Clause(cut_(near), gap=int(gap or 10))
        else:
            clause = Clause(cut_(phrase or word), prefix=bool(star) or word.endswith("*"))
        if clause.words:
            groups[-1][1 if no else 0].append(clause)
        no = False
    groups = [g for g in groups if g[0]]
    if not groups:
        raise ValueError(f"nothing to look for in {text!r}")
    return groups


def match(index: Index, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, hits, first, score of the documents that match: clause hits, the first place of one, and BM25 over the wanted clauses."""
    groups = parse_match(text)
    slots: list[tuple[str, bool]] = []
    for wanted, unwanted in groups:
        for c in wanted + unwanted:
            slots += [s for s in ((w, c.prefix and i == len(c.words) - 1) for i, w in enumerate(c.words)) if s not in slots]
    holds = lambda s: F.startswith("term", F.lit(s[0])) if s[1] else F.col("term") == s[0]
    plain = [w for w, p in slots if not p]
    needed = reduce(lambda x, y: x | y, [*([F.col("term").isin(plain)] if plain else []), *(holds(s) for s in slots if s[1])])
    places = lambda s: F.flatten(F.collect_list(F.when(holds(s), F.col("at"))))  # noqa: E731  places in one text
    before = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))
    posts = index.segments.where(needed).select("term", "lens", "ends", "at", F.posexplode("keys").alias("i", "key"))
    posts = posts.select("term", "key", F.get("lens", F.col("i")).alias("len"), F.slice("at", before + 1, F.get("ends", F.col("i")) - before).alias("at"))
    met = posts.groupBy("key").agg(F.max("len").alias("len"), *(places(s).alias(f"s{i}") for i, s in enumerate(slots)))

    def back(places: int):
        return lambda x: x - places

    def found(c: Clause) -> Column:
        """Places where the clause begins, or, for NEAR, where its first term has all others near."""
        own = [F.col(f"s{slots.index((w, c.prefix and i == len(c.words) - 1))}") for i, w in enumerate(c.words)]
        if c.gap is None:
            shifted = [F.transform(p, back(i)) if i else p for i, p in enumerate(own)]
            return reduce(F.array_intersect, shifted, F.array_distinct(shifted[0]))
        around = lambda p: F.array_distinct(F.flatten(F.transform(p, lambda x: F.sequence(x - c.gap - 1, x + c.gap + 1))))
        return reduce(lambda x, p: F.array_intersect(x, around(p)), own[1:], F.array_distinct(own[0]))

    every = [c for wanted, unwanted in groups for c in wanted + unwanted]
    rows = met.select("key", "len", *(found(c).alias(f"c{i}") for i, c in enumerate(every)))
    has = lambda c: F.size(f"c{every.index(c)}") > 0
    all_of = lambda tests: reduce(lambda x, y: x & y, tests)
    rows = cut(rows.withColumn("match", reduce(lambda x, y: x | y, [all_of([*map(has, wanted), *(~has(c) for c in unwanted)]) for wanted, unwanted in groups])))
    positive = [i for i, c in enumerate(every) if any(c is w for wanted, _ in groups for w in wanted)]
    df = rows.agg(*(F.sum((F.size(f"c{i}") > 0).cast("long")).alias(f"d{i}") for i in positive)).first()

    def part(i: int) -> Column:
        tf, d = F.size(f"c{i}"), float(df[f"d{i}"] or 0)
        idf = float(np.log((index.n - d + 0.5) / (d + 0.5) + 1))
        return F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / max(index.mean, 1e-9)))

    score = reduce(lambda x, y: x + y, map(part, positive))
    first = F.least(*(F.array_min(f"c{i}") for i in positive), F.lit(None).cast("int"))
    hits = reduce(lambda x, y: x + y, [F.size(f"c{i}") for i in positive])
    return rows.where("match").select(F.col("key").alias(index.key), hits.cast("long").alias("hits"), first.alias("first"), score.alias("score"))
