"""Queries on review work: queues, look-ups, provider choice, medical extraction, line fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import medical as M
from lexforge.operators import review as V
from lexforge.plans.base import query
from lexforge.session import table

@query("""SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 25""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_size").alias("confidence"))
    return V.review_queue(rows, "low_conf", 25, "p_partkey").select("p_partkey", "p_size")


@query("""WITH t AS (SELECT DISTINCT p_name FROM part), c AS (SELECT DISTINCT p_name AS original, upper(p_name) AS corrected FROM part WHERE p_size > 25),
e AS (SELECT p_name, corrected, 1.0::DOUBLE AS similarity, 'exact' AS match FROM t JOIN c ON original = p_name), l AS (SELECT *, list_distinct(string_split(original, '')) AS y FROM c),
r AS (SELECT p_name, list_distinct(string_split(p_name, '')) AS x FROM t WHERE p_name NOT IN (SELECT p_name FROM e))
SELECT * FROM e UNION ALL SELECT p_name, corrected, round(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity, 'fuzzy' AS match FROM r, l
WHERE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) > 0.8""")
def correction_lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    fixes = parts.where("p_size > 25").select(F.col("p_name").alias("original"), F.upper("p_name").alias("corrected")).distinct()
    return V.match_corrections(parts.select("p_name").distinct(), fixes, "p_name").withColumn("similarity", F.round("similarity", 6))


@query("""WITH w AS (SELECT p_name, list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM (SELECT DISTINCT p_name FROM part)),
q AS (SELECT p_name AS q, g FROM w WHERE p_name LIKE 'blue%')
SELECT q, p_name, round(len(list_intersect(q.g, w.g))::DOUBLE / (len(q.g) + len(w.g) - len(list_intersect(q.g, w.g))), 6) AS similarity FROM q, w
WHERE len(list_intersect(q.g, w.g))::DOUBLE / (len(q.g) + len(w.g) - len(list_intersect(q.g, w.g))) >= 0.3""")
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_name").distinct()
    got = V.trigram_search(parts.where("p_name like 'blue%'").select(F.col("p_name").alias("q")), parts, "q", "p_name")
    return got.withColumn("similarity", F.round("similarity", 6))


@query("""SELECT s_suppkey AS id, s_acctbal AS cost FROM supplier WHERE s_nationkey < 20 ORDER BY (s_nationkey = 3) DESC, s_nationkey DESC, s_acctbal, s_name LIMIT 1""")
def fallback_pick(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("provider"), F.col("s_nationkey").alias("tier"), F.col("s_acctbal").alias("cost"), F.lit(False).alias("limited"))
    return V.fallback_model(models, 20, "3").select("id", "cost")


@query("""SELECT * FROM (SELECT 'priority' AS strategy, s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'lru', s_suppkey FROM supplier ORDER BY CASE WHEN s_nationkey > 3 THEN s_nationkey END NULLS FIRST, s_suppkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'round_robin', s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET (SELECT 1234567 % count(*) FROM supplier))""")
def account_pick(spark: SparkSession, d: str) -> DataFrame:
    used = F.when(F.col("s_nationkey") > 3, F.col("s_nationkey"))
    accounts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("priority"), used.alias("last_used"), F.lit(True).alias("active"))
    picks = [V.next_account(accounts, s, 1234567).select(F.lit(s).alias("strategy"), "id") for s in ("priority", "lru", "round_robin")]
    return picks[0].unionAll(picks[1]).unionAll(picks[2])


@query("""SELECT l_orderkey, arg_max(l_returnflag, (length(l_returnflag), l_discount, l_linestatus, l_returnflag)) AS text FROM lineitem GROUP BY l_orderkey""")
def fused_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("engine"), F.col("l_returnflag").alias("text"), F.col("l_discount").alias("confidence"))
    return V.fused_lines(rows, "l_orderkey", "longest_text", {"F": 0.9, "O": 0.8}).select("l_orderkey", "text")


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) <> '' THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) ELSE substr(text, 1, 200) END AS summary FROM documents""")
def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", M.lead_summary(F.col("text")).alias("summary"))
