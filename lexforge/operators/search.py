"""Search: boolean queries, BM25 over a postings table, relevance, paging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.normalize import bound
from lexforge.operators.relational import contains_any
from lexforge.session import cut

_TOKEN = re.compile(r'"([^"]+)"|(\S+)')


def parse_boolean(text: str) -> dict[str, list[str]]:
    """must, any and none terms of a query with AND, OR, NOT and quoted phrases.

    A first term joins the any-terms if OR follows it, so `a OR b` means either; terms side by
    side are ANDed.
    """
    out: dict[str, list[str]] = {"must": [], "any": [], "none": []}
    op, last = "AND", None
    for phrase, word in _TOKEN.findall(text):
        if word in ("AND", "OR", "NOT"):
            if word == "OR" and last in out["must"]:
                out["must"].remove(last)
                out["any"].append(last)
            op = word
            continue
        term = phrase or word
        out[{"AND": "must", "OR": "any", "NOT": "none"}[op]].append(term)
        last, op = term, "AND"
    return out


def boolean_condition(df: DataFrame, text: str, columns: list[str]) -> Column:
    """The query as a condition over columns: all of must, one of any (if there are some), none of none."""
    q = parse_boolean(text)
    tests = [contains_any(df, t, columns) for t in q["must"]]
    if q["any"]:
        tests.append(reduce(lambda a, b: a | b, [contains_any(df, t, columns) for t in q["any"]]))
    tests += [~contains_any(df, t, columns) for t in q["none"]]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, len: one row per term and document; the table to store and search by term."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(key, tokens.alias("w")).select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    return rows.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def corpus_size(docs: DataFrame, text: str) -> DataFrame:
    """One row: n documents and their mean length in terms."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens)).alias("avg_len"))


def bm25(index: DataFrame, size: DataFrame, terms: list[str], key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that hold any of terms; size is the one-row corpus_size."""
    hits = index.where(F.col("term").isin([t.lower() for t in terms]))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row per query term
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(size))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy(key).agg(F.sum(part).alias("score"))


def bm25_scan(docs: DataFrame, terms: list[str], key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score as bm25() over postings, without an index: texts are cut in terms once, and only
    lengths and the frequencies of the query's terms are kept."""
    terms = sorted({t.lower() for t in terms})
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = lambda w: F.struct(F.size(w).alias("len"), *(F.size(_equal(w, t)).alias(f"tf{i}") for i, t in enumerate(terms)))
    rows = cut(docs.select(key, bound(tokens, counts).alias("c")).select(key, "c.*"))
    size = rows.agg(F.count("len").alias("n"), F.avg("len").alias("avg_len"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0)

    hits = rows.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(size))  # one row
    return hits.select(key, reduce(lambda x, y: x + y, map(part, range(len(terms)))).alias("score"))


def _equal(w: Column, term: str) -> Column:
    return F.filter(w, lambda x: x == term)


def relevance(q: str, term: Column, frequency: Column, category: Column) -> Column:
    """Exact match 10, substring up to 5 by share of the term, frequency up to 1, half for a category."""
    exact = F.when(F.lower(term) == q.lower(), 10.0).otherwise(0.0)
    inside = F.when(F.contains(F.lower(term), F.lit(q.lower())), 5.0 * len(q) / F.greatest(F.char_length(term), F.lit(1))).otherwise(0.0)
    return F.round(exact + inside + 0.1 * F.least(frequency, F.lit(10)) + F.when(category.isNotNull(), 0.5).otherwise(0.0), 2)


def term_cosine(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """key_a, key_b, similarity of documents that share a term, from postings(term, key, tf)."""
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(f"norm_{k}"))
    dot = a.select("term", key_a, F.col("tf").alias("x")).join(b.select("term", key_b, F.col("tf").alias("y")), "term").groupBy(key_a, key_b).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = dot.join(norm(a, key_a), key_a).join(norm(b, key_b), key_b)
    return both.select(key_a, key_b, (F.col("dot") / (F.col(f"norm_{key_a}") * F.col(f"norm_{key_b}"))).alias("similarity"))
