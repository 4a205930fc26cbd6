"""Queries on duplicates, contamination, embeddings and neighbour prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import similarity as M
from lexforge.operators import dedup as U
from lexforge.operators import density
from lexforge.operators import learn as L
from lexforge.plans.base import query
from lexforge.session import table

_DOT = "list_dot_product(a.v, b.v)"


@query("""SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return U.exact_groups(table(spark, d, "documents"), "doc_id", "text")


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS k FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM c),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k)
SELECT a, b, round(shared::DOUBLE / (na + nb - shared), 6) AS similarity FROM p WHERE shared::DOUBLE / (na + nb - shared) >= 0.8
UNION ALL SELECT c.k, s.doc_id, 1.0 FROM s JOIN c ON c.s = s.s WHERE c.k <> s.doc_id""")
def near_dups(spark: SparkSession, d: str) -> DataFrame:
    return U.shingle_links(table(spark, d, "documents"), "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


def _grams(name: str, key: str) -> str:
    tail = " || ' ' || ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, w || ' ' || {tail} AS g FROM (SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {name})) WINDOW o AS (PARTITION BY {key} ORDER BY i)) WHERE g IS NOT NULL"


@query(f"WITH b AS ({_grams('benchmark', 'item_id')}), t AS ({_grams('documents', 'doc_id')}) SELECT doc_id, item_id, count(*) AS shared FROM t JOIN b USING (g) GROUP BY doc_id, item_id")
def benchmark_contamination(spark: SparkSession, d: str) -> DataFrame:
    return U.shared_grams(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", 8)


@query()
def cer_grade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("r"), F.replace(F.col("text"), F.lit("th"), F.lit("t")).alias("h"))
    rate = M.cer(F.col("r"), F.col("h"))
    return rows.select("item_id", F.round(rate, 6).alias("cer"), M.grade(rate).alias("grade"))


@query()
def corpus_error_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(F.col("text").alias("r"), F.replace(F.col("text"), F.lit("th"), F.lit("t")).alias("h")).where("char_length(r) > 0")
    edits, n = F.levenshtein("r", "h"), F.char_length("r")
    return rows.agg(F.round(F.sum(edits) / F.sum(n), 6).alias("micro"), F.round(F.avg(edits / n), 6).alias("macro"), F.round(F.avg((F.col("r") == F.col("h")).cast("int")), 6).alias("exact"), F.count(F.lit(1)).alias("n"))


@query()
def word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", "text", F.replace(F.col("text"), F.lit("th"), F.lit("t")).alias("h"))
    return rows.select("item_id", F.round(M.wer(F.col("text"), F.col("h")), 6).alias("wer"))


@query()
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("text", F.replace(F.col("text"), F.lit("th"), F.lit("t")).alias("h"))
    return M.confusions(rows, "text", "h")


@query()
def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    """The characters of the benchmark texts that a worse reading gets wrong most often, and what it takes them for."""
    read = F.translate(F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("t")), F.lit("rn"), F.lit("m")), "lo", "1")
    return M.top_confusions(table(spark, d, "benchmark").select("text", read.alias("h")), "text", "h")


@query()
def marked_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", "text", F.replace(F.col("text"), F.lit("th"), F.lit("t")).alias("h"))
    return rows.select("item_id", M.marked_differences("text", "h").alias("marked"))


@query()
def seq_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", "text", F.lower("text").alias("low"))
    return rows.select("item_id", F.round(M.sequence_ratio("text", "low"), 6).alias("ratio"))


_NORMED = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"""SELECT q, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, vec_id) AS r FROM (
SELECT a.vec_id AS q, b.vec_id, round({_DOT} / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM {_NORMED} a JOIN {_NORMED} b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE r <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return L.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5, tenant="label")


@query(f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS r FROM (SELECT a.vec_id AS q, b.vec_id, b.label, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS d
FROM {_NORMED} a JOIN {_NORMED} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE r <= 5), v AS (SELECT q, label, sum(1 / greatest(d, 1e-6)) AS w FROM n GROUP BY q, label),
t AS (SELECT q, sum(w) AS total FROM v GROUP BY q), a AS (SELECT q, avg(d) AS avg_d FROM n GROUP BY q)
SELECT q, label, round_even(least(greatest(0.6 * w / total + 0.4 * least(greatest(1 - 0.8 * avg_d, 0), 1), 0.3), 0.98), 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(w, 6) DESC, label) AS r FROM v) JOIN t USING (q) JOIN a USING (q) WHERE r = 1""")
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return L.knn_predict(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "label", 5)


@query("""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding, embedding))) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.42),
r AS (SELECT DISTINCT a AS node, a AS component FROM l UNION SELECT l.b, r.component FROM r JOIN l ON l.a = r.node)
SELECT node, min(component) AS component FROM r GROUP BY node""")
def dedup_components(spark: SparkSession, d: str) -> DataFrame:
    return density.linked_rows(table(spark, d, "embeddings"), "vec_id", "embedding", 0.42)[0]


@query("""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.35),
core AS (SELECT a AS node FROM l GROUP BY a HAVING count(*) + 1 >= 3), cl AS (SELECT a, b FROM l JOIN core x ON x.node = a JOIN core y ON y.node = b),
r AS (SELECT node, node AS component FROM core UNION SELECT cl.b, r.component FROM r JOIN cl ON cl.a = r.node), c AS (SELECT node, min(component) AS cluster FROM r GROUP BY node),
n AS (SELECT l.a AS node, min(c.cluster) AS found FROM l JOIN c ON c.node = l.b GROUP BY l.a)
SELECT vec_id, CASE WHEN c.node IS NOT NULL THEN 'core' WHEN n.node IS NOT NULL THEN 'border' ELSE 'noise' END AS kind, coalesce(c.cluster, n.found) AS cluster FROM e LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.node = vec_id""")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35, 3)


@query()
def hierarchical_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The most stable density clusters of all vectors from cosine 0.95 down to 0.7; vectors of different labels are never linked."""
    got = density.hierarchical_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", "label", min_samples=2, min_size=2)
    return got.select("vec_id", "cluster", "rung", F.round("stability", 6).alias("stability"))


@query()
def cluster_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    named, links = density.linked_rows(e, "vec_id", "embedding", 0.42)
    got = U.merged_clusters(e, named, links, "vec_id", F.col("vec_id").cast("string"))
    return got.withColumn("score", F.round("score", 6))


@query("""SELECT round((1 - count(DISTINCT text)::DOUBLE / count(*)) * 100, 1) AS dedup_ratio, count(*) AS total, count(DISTINCT text) AS distinct_texts FROM documents""")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("text").alias("distinct_texts"))
    return got.select(F.round((1 - F.col("distinct_texts") / F.col("total")) * 100, 1).alias("dedup_ratio"), "total", "distinct_texts")


@query()
def diversity_sample(spark: SparkSession, d: str) -> DataFrame:
    return L.farthest_points(table(spark, d, "embeddings"), "vec_id", "embedding", 6)
