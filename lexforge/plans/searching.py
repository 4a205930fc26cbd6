"""Search queries: filters, boolean language, BM25, snippets, relevance, term cosine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import normalize as N
from lexforge.operators import positions as P
from lexforge.operators import relational as R
from lexforge.operators import search as S
from lexforge.plans.base import query
from lexforge.session import table


@query("""SELECT doc_id, lang, n_chars, substr(text, 1, 500) AS preview FROM documents WHERE (text ILIKE '%version%' OR source ILIKE '%version%') AND lang = 'en' AND n_chars >= 200
ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5""")
def archive_search_like(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = R.filtered(docs.where(R.contains_any(docs, "version", ["text", "source"])), equals={"lang": "en"}, at_least={"n_chars": 200})
    return hits.select("doc_id", "lang", "n_chars", F.substring("text", 1, 500).alias("preview")).orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(20)


@query("""SELECT doc_id, source FROM documents WHERE (text ILIKE '%license%' OR text ILIKE '%token%') AND NOT text ILIKE '%Apache%'""")
def boolean_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(S.boolean_condition(docs, "license OR token NOT Apache", ["text"])).select("doc_id", "source")


@query("""SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%version 2%' AND NOT text ILIKE '%token%'""")
def boolean_search_must(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(S.boolean_condition(docs, 'the AND "version 2" NOT token', ["text"])).select("doc_id")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w), p AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w),
t AS (SELECT term, doc_id, count(*) AS tf, any_value(len) AS len FROM p WHERE term IN ('license', 'apache', 'version') GROUP BY term, doc_id),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM t JOIN f USING (term), s GROUP BY doc_id""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    got = S.bm25_scan(docs, ["license", "Apache", "version"], "doc_id", "text")
    return got.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id")


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM w), p AS (SELECT item_id, len(w) AS len, unnest(w) AS term FROM w),
t AS (SELECT term, item_id, count(*) AS tf, any_value(len) AS len FROM p WHERE term IN ('the', 'und') GROUP BY term, item_id), f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT item_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM t JOIN f USING (term), s GROUP BY item_id""")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    got = S.bm25(S.postings(items, "item_id", "text"), S.corpus_size(items, "text"), ["the", "und"], "item_id")
    return got.select("item_id", F.round("score", 6).alias("score"))


MATCHES = ['"of the"', "NEAR(and the to, 3)", "licen* version", '"the apache license" OR token NOT "de la"']


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), t AS (SELECT doc_id, len(w) AS len, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p FROM w),
c AS (SELECT 0 AS q, 0 AS c, a.doc_id, a.len, a.p FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.term = 'of' AND b.term = 'the'
UNION SELECT 1, 0, a.doc_id, a.len, a.p FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(b.p - a.p) <= 4 JOIN t c ON a.doc_id = c.doc_id AND abs(c.p - a.p) <= 4 WHERE a.term = 'and' AND b.term = 'the' AND c.term = 'to'
UNION SELECT 2, 0, doc_id, len, p FROM t WHERE starts_with(term, 'licen') UNION SELECT 2, 1, doc_id, len, p FROM t WHERE term = 'version'
UNION SELECT 3, 0, a.doc_id, a.len, a.p FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN t c ON a.doc_id = c.doc_id AND c.p = a.p + 2 WHERE a.term = 'the' AND b.term = 'apache' AND c.term = 'license'
UNION SELECT 3, 1, doc_id, len, p FROM t WHERE term = 'token' UNION SELECT 3, 2, a.doc_id, a.len, a.p FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.term = 'de' AND b.term = 'la'),
k AS (SELECT q, c, doc_id, any_value(len) AS len, count(*) AS tf, min(p) AS first FROM c GROUP BY q, c, doc_id), f AS (SELECT q, c, count(*) AS df FROM k GROUP BY q, c),
m AS (SELECT q, doc_id, bool_or(c = 0) AS c0, bool_or(c = 1) AS c1, bool_or(c = 2) AS c2 FROM k GROUP BY q, doc_id HAVING CASE q WHEN 2 THEN c0 AND c1 WHEN 3 THEN c0 OR (c1 AND NOT c2) ELSE c0 END)
SELECT q AS asked, doc_id, CAST(sum(tf) AS BIGINT) AS hits, min(first) AS first, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM m JOIN k USING (q, doc_id) JOIN f USING (q, c), s WHERE NOT (q = 3 AND c = 2) GROUP BY q, doc_id""")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, nearness, beginnings and their combinations over an index of all documents."""
    index = P.positional_index(table(spark, d, "documents"), "doc_id", "text")
    got = [P.match(index, q).select(F.lit(i).alias("asked"), "doc_id", "hits", "first", F.round("score", 6).alias("score")) for i, q in enumerate(MATCHES)]
    return reduce(DataFrame.unionAll, got)


@query("""SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN greatest(p - 100, 1) > 1 THEN '...' ELSE '' END || substr(text, greatest(p - 100, 1), p + 107 - greatest(p - 100, 1)) || CASE WHEN p + 107 <= length(text) THEN '...' ELSE '' END
ELSE substr(text, 1, 200) END AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents)""")
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.snippet(F.col("text"), "license").alias("snippet"))


@query("""SELECT p_partkey, round(CASE WHEN lower(p_name) = 'blue bolt' THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(p_name), 'blue bolt') THEN 5.0::DOUBLE * 9 / greatest(length(p_name), 1) ELSE 0 END + 0.1::DOUBLE * least(p_size, 10)
+ CASE WHEN p_brand IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END, 2) AS score FROM part WHERE contains(lower(p_name), 'blue')""")
def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("blue")))
    return parts.select("p_partkey", S.relevance("blue bolt", F.col("p_name"), F.col("p_size"), F.col("p_brand")).alias("score")).orderBy(F.desc("score"), "p_partkey")


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), t AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM w) GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(tf * tf)) AS norm FROM t GROUP BY item_id)
SELECT x.item_id AS item_a, y.item_id AS item_b, round(sum(x.tf * y.tf) / (any_value(a.norm) * any_value(b.norm)), 6) AS similarity FROM t x JOIN t y ON x.term = y.term JOIN n a ON a.item_id = x.item_id JOIN n b ON b.item_id = y.item_id
WHERE x.item_id < y.item_id GROUP BY x.item_id, y.item_id""")
def bow_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = S.postings(table(spark, d, "benchmark"), "item_id", "text")
    a, b = p.withColumnRenamed("item_id", "item_a"), p.withColumnRenamed("item_id", "item_b")
    got = S.term_cosine(a, b, "item_a", "item_b").where("item_a < item_b")
    return got.withColumn("similarity", F.round("similarity", 6))
