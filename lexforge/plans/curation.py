"""Curation queries: validation, triage, promotion, splits, samplers, fusion of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import curate as C
from lexforge.operators import learn as L
from lexforge.plans.base import query
from lexforge.session import table


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns, whole, in the role of engine readings, with a confidence from a hash."""
    conf = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(50)) / 100.0 + 0.5
    return table(spark, d, "conversations").select("conv_id", F.col("role").alias("engine"), "text", conf.alias("confidence"), F.col("turn").alias("y"))


_READINGS = "(SELECT conv_id, role AS engine, text, ((conv_id * 7 + turn * 13) % 50) / 100.0::DOUBLE + 0.5 AS confidence, turn AS y FROM conversations)"


@query("""SELECT conv_id, turn, non_empty AND changed AND ratio_ok AS is_valid, round(CASE WHEN ratio_ok THEN 1.0 ELSE 0.7 END::DOUBLE, 6) AS score FROM (
SELECT conv_id, turn, trim(text) <> '' AND trim(nxt) <> '' AS non_empty, text <> nxt AS changed, length(nxt)::DOUBLE / greatest(length(text), 1) BETWEEN 0.3 AND 3.0 AS ratio_ok FROM (
SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)""")
def qa_validate(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("nxt", nxt).where("nxt is not null")
    got = rows.select("conv_id", "turn", C.validated(F.col("text"), F.col("nxt")).alias("v"))
    return got.select("conv_id", "turn", "v.is_valid", F.round("v.score", 6).alias("score"))


@query("""SELECT user_id, event_type, CASE WHEN agreement >= 0.25 AND conf >= 0.3 THEN 'auto_train' WHEN agreement >= 0.15 THEN 'needs_review' ELSE 'discarded' END AS decision FROM (
SELECT user_id, event_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS agreement, avg(value) / 100 AS conf FROM events GROUP BY user_id, event_type)""")
def triage(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") / 100).alias("conf"))
    rows = rows.withColumn("agreement", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return rows.select("user_id", "event_type", C.triage(F.col("agreement"), F.col("conf"), accept=0.25, review=0.15, confidence=0.3).alias("decision"))


@query("""WITH m AS (SELECT max(ts)::DATE AS t FROM events), e AS (SELECT user_id, event_type, count(*) AS freq, max(value) / 100 AS after, min(value) / 100 AS before, max(ts)::DATE AS seen FROM events GROUP BY ALL)
SELECT user_id, event_type, freq >= 3 AND after - before >= 0.05 AND after >= 0.8 AND date_diff('day', seen, t) <= 30 AS promote,
(CASE WHEN freq < 3 THEN 1 ELSE 0 END + CASE WHEN after - before < 0.05 THEN 1 ELSE 0 END + CASE WHEN after < 0.8 THEN 1 ELSE 0 END + CASE WHEN date_diff('day', seen, t) > 30 THEN 1 ELSE 0 END)::INT AS n_reasons FROM e, m""")
def promotion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("frequency"), (F.max("value") / 100).alias("after"), (F.min("value") / 100).alias("before"), F.max("ts").alias("seen"))
    last = table(spark, d, "events").agg(F.max("ts").alias("t"))
    got = rows.join(F.broadcast(last)).select("user_id", "event_type", C.promotion(F.col("frequency"), F.col("before"), F.col("after"), F.datediff("t", "seen"), F.lit(False)).alias("p"))
    return got.select("user_id", "event_type", "p.promote", F.size("p.reasons").alias("n_reasons"))


@query("""SELECT l.doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (
SELECT doc_id, row_number() OVER (ORDER BY quality DESC, doc_id) AS r, count(*) OVER () AS n FROM labels) l""")
def split_by_quality(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_split(table(spark, d, "labels"), ["quality"], "doc_id", 0.8, 0.1).select("doc_id", "split")


@query()
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return C.hash_split(table(spark, d, "documents"), "doc_id", 0.8, 0.1, 42).select("doc_id", "split")


@query("""SELECT doc_id, quality FROM labels ORDER BY quality, doc_id LIMIT 20""")
def uncertainty_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", "quality").orderBy("quality", "doc_id").limit(20)


@query("""SELECT user_id, round(1 - max(n)::DOUBLE / sum(n), 6) AS disagreement FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def committee(spark: SparkSession, d: str) -> DataFrame:
    got = L.committee_disagreement(table(spark, d, "events"), "user_id", "event_type")
    return got.select("user_id", F.round("disagreement", 6).alias("disagreement"))


@query("""SELECT p_partkey, p_size AS usage, ((CASE WHEN c < 0.6 THEN 3 WHEN c < 0.8 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 50 THEN 2 ELSE 0 END))::INT AS score,
CASE WHEN (CASE WHEN c < 0.6 THEN 3 WHEN c < 0.8 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 50 THEN 2 ELSE 0 END) >= 5 THEN 'urgent' WHEN (CASE WHEN c < 0.6 THEN 3 WHEN c < 0.8 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 50 THEN 2 ELSE 0 END) >= 3 THEN 'review' ELSE 'ok' END AS indicator
FROM (SELECT *, round((p_retailprice % 100) / 100, 6) AS c FROM part)""")
def rule_indicator(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("c", F.round(F.col("p_retailprice") % 100 / 100, 6))
    got = rows.select("p_partkey", F.col("p_size").alias("usage"), C.rule_indicator(F.col("c"), F.lit(False), F.col("p_size"), F.lit(40), F.lit(10)).alias("i"))
    return got.select("p_partkey", "usage", "i.score", "i.indicator")


@query(f"""SELECT conv_id, arg_max(text, (confidence, CASE engine WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END, engine, y)) AS text, max(confidence) AS confidence FROM {_READINGS} GROUP BY conv_id""")
def fusion_best(spark: SparkSession, d: str) -> DataFrame:
    got = L.best_confidence(_readings(spark, d), "conv_id", "engine", "text", "confidence", {"user": 2, "assistant": 1}, order="y")
    return got.select("conv_id", "text", "confidence")


@query(f"""SELECT conv_id, CASE WHEN round(c[1] - coalesce(c[2], -1), 9) >= 0.15 THEN 'best' ELSE 'vote' END AS choice FROM (SELECT conv_id, list_reverse_sort(list(confidence)) AS c FROM {_READINGS} GROUP BY conv_id)""")
def smart_fallback(spark: SparkSession, d: str) -> DataFrame:
    return L.smart_fallback(_readings(spark, d), "conv_id", "engine", "text", "confidence")


@query(f"""SELECT conv_id, string_agg(w, ' ' ORDER BY y, length(w), w COLLATE "POSIX") AS fused FROM (SELECT conv_id, w, round(avg(y), 6) AS y FROM (
SELECT conv_id, y::DOUBLE AS y, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM {_READINGS}) GROUP BY conv_id, w) GROUP BY conv_id""")
def word_vote(spark: SparkSession, d: str) -> DataFrame:
    return L.word_vote(_readings(spark, d), "conv_id", "text", "confidence", "y")


@query()
def char_vote(spark: SparkSession, d: str) -> DataFrame:
    return L.char_vote(_readings(spark, d), "conv_id", "text", "confidence")


@query()
def spatial_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.element_at(F.array(F.lit("surya"), F.lit("trocr"), F.lit("easyocr")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("engine"), F.col("l_returnflag").alias("text"), (0.5 + F.col("l_discount") * 4).alias("confidence"), (F.col("l_linenumber") * 6.0).alias("x"), F.col("l_quantity").alias("y"))
    return L.spatial_fusion(rows, "l_orderkey", ["R"])


@query("""SELECT event_type, count(*) AS frequency, round(max(value), 6) AS max_gain, count(*) >= 3 AS promotable FROM events GROUP BY event_type""")
def correction_memory(spark: SparkSession, d: str) -> DataFrame:
    got = C.memory(table(spark, d, "events"), ["event_type"], "value", "event_id")
    return got.select("event_type", "frequency", F.round("max_gain", 6).alias("max_gain"), (F.col("frequency") >= 3).alias("promotable"))


@query("""SELECT 'Summarise' AS instruction, q.text AS input, a.text AS output FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""")
def instruction_pairs(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.export import instructions

    turns = table(spark, d, "conversations")
    q, a = turns.where("role = 'user'").alias("q"), turns.where("role = 'assistant'").alias("a")
    both = q.join(a, (F.col("a.conv_id") == F.col("q.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1))
    return instructions(both, F.lit("Summarise"), F.col("q.text"), F.col("a.text"))
