"""Queries on the remaining operators: updates, diffs, matching, cleaning, features, samples, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import detect as D
from lexforge.functions import normalize as N
from lexforge.functions import similarity as M
from lexforge.operators import curate as C
from lexforge.operators import dedup as U
from lexforge.operators import export as X
from lexforge.operators import extend as E
from lexforge.operators import learn as L
from lexforge.operators import relational as R
from lexforge.operators import review as V
from lexforge.plans.base import query
from lexforge.plans.notes import pick
from lexforge.session import shared_folder, table
from lexforge.sources import readers
from lexforge.streaming import windows

_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"
_ALL = "regexp_extract_all"


# --- changes of tables


@query("""SELECT c_custkey, coalesce(o.m, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.lit("hacked").alias("c_mktsegment"))
    return R.update_by_key(table(spark, d, "customer"), changes, ["c_custkey"], ["c_acctbal"]).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("""SELECT c_nationkey, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE NOT coalesce(c_acctbal < 0, false) GROUP BY c_nationkey""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    left, (rest,) = R.delete_where(table(spark, d, "customer"), F.col("c_acctbal") < 0, [(orders, ["c_custkey"])])
    return left.join(rest, "c_custkey", "left").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 2), r AS (SELECT child, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT r.child, e.parent, r.distance + 1 FROM r JOIN e ON e.child = r.ancestor)
SELECT child, ancestor, min(distance)::INT AS distance FROM r GROUP BY child, ancestor""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "part").where("p_partkey > 2").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return R.lineage(edges, "child", "parent")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 50""")
def oldest_evicted(spark: SparkSession, d: str) -> DataFrame:
    return C.evicted(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query("""SELECT hash, first, doc_id FROM (SELECT sha256(text) AS hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1""")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return U.group_members(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT o_custkey, a <> b AS conflict FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderkey % 2 = 0)) AS a, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderkey % 2 = 1)) AS b FROM orders GROUP BY o_custkey) WHERE a IS NOT NULL AND b IS NOT NULL""")
def set_conflicts(spark: SparkSession, d: str) -> DataFrame:
    some = lambda r: F.collect_set(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderstatus")))
    got = table(spark, d, "orders").groupBy("o_custkey").agg(some(0).alias("a"), some(1).alias("b")).where("size(a) > 0 and size(b) > 0")
    return got.select("o_custkey", R.sets_conflict(F.col("a"), F.col("b")).alias("conflict"))


# --- text pairs and matching


@query(f"""SELECT item_id, array_to_string(list_transform(list_filter(list_zip(a, b), lambda p: p[1] <> p[2]), lambda p: p[1] || '>' || p[2]), ' ') AS changed FROM (SELECT item_id, {_WORDS('text')} AS a, {_WORDS("replace(text, 'th', 't')")} AS b FROM benchmark) WHERE len(a) = len(b)""")
def positional_diff(spark: SparkSession, d: str) -> DataFrame:
    diff = R.positional_diff(F.col("text"), F.replace("text", F.lit("th"), F.lit("t")))
    rows = table(spark, d, "benchmark").select("item_id", diff.alias("p")).where("p is not null")
    return rows.select("item_id", F.array_join(F.transform("p", lambda x: F.concat_ws(">", x.original, x.corrected)), " ").alias("changed"))


@query("""SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_brand, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ''), string_split(p_brand, '')))), 6) AS letters,
round(len(list_filter(list_zip(string_split(p_name, ''), string_split(p_brand, '')), lambda p: p[1] = p[2]))::DOUBLE / greatest(length(p_name), length(p_brand)), 6) AS places FROM part""")
def letter_similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", F.round(M.char_set_similarity(a, b), 6).alias("letters"), F.round(M.positional_similarity(a, b), 6).alias("places"))


@query("""WITH l AS (SELECT [min(l_quantity), min(l_discount), min(l_tax), 7.0] AS lo, [max(l_quantity), max(l_discount), max(l_tax), 7.0] AS hi FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax, 7.0] AS a, lead([l_quantity, l_discount, l_tax, 7.0]) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt(pow((a[1] - b[1]) / (hi[1] - lo[1]), 2) + pow((a[2] - b[2]) / (hi[2] - lo[2]), 2) + pow((a[3] - b[3]) / (hi[3] - lo[3]), 2)), 6) AS distance FROM v, l WHERE b IS NOT NULL""")
def scaled_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    vector = F.array("l_quantity", "l_discount", "l_tax", F.lit(7.0))
    ends = rows.agg(F.array(F.min("l_quantity"), F.min("l_discount"), F.min("l_tax"), F.lit(7.0)).alias("lo"), F.array(F.max("l_quantity"), F.max("l_discount"), F.max("l_tax"), F.lit(7.0)).alias("hi"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    pairs = rows.select("l_orderkey", "l_linenumber", vector.alias("a"), F.lead(vector).over(order).alias("b")).where("b is not null")
    return pairs.join(F.broadcast(ends)).select("l_orderkey", "l_linenumber", F.round(M.scaled_distance(F.col("a"), F.col("b"), F.col("lo"), F.col("hi")), 6).alias("distance"))


@query("""SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT user_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def vote_entropy(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("n"), F.sum("n").alias("all"))
    return n.select("user_id", F.round(M.entropy(F.transform("n", lambda x: x / F.col("all"))), 6).alias("entropy"))


@query("""SELECT length(text) AS length, count(*) AS n, round(avg(abs(length(text) - length(replace(text, 'th', 't')))::DOUBLE / length(text)), 6) AS avg_cer FROM benchmark WHERE length(text) > 0 GROUP BY 1""")
def error_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Leaving letters out costs one edit each, which SQL can count without an edit distance."""
    rows = table(spark, d, "benchmark").where("char_length(text) > 0").select("text", F.replace("text", F.lit("th"), F.lit("t")).alias("h"))
    return M.error_by_length(rows, "text", "h").withColumn("avg_cer", F.round("avg_cer", 6))


@query("""SELECT l_orderkey, round(avg(l_discount), 6) AS confidence FROM lineitem GROUP BY l_orderkey""")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").alias("confidence"))).alias("t"))  # lines of one order
    return tokens.select("l_orderkey", F.round(M.mean_confidence(F.col("t")), 6).alias("confidence"))


# --- cleaning


@query("""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'unknown' WHEN e = 0 THEN 'unknown' WHEN a / (a + e) > 0.7 THEN 'ar' WHEN e / (a + e) > 0.7 THEN 'en' ELSE 'mixed' END AS script FROM (SELECT *, len(regexp_extract_all(text, '[A-Za-z]')) AS e, len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) AS a FROM conversations)""")
def strict_language(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "conversations").select("conv_id", "turn", D.language(F.col("text"), strict=True).alias("l"))
    return got.select("conv_id", "turn", F.col("l.lang").alias("script"))


@query("""SELECT conv_id, turn, length(text) > 2000 OR regexp_matches(text, '(?i)<script') OR regexp_matches(text, '(?i)\\b(?:union\\s+select|drop\\s+table|insert\\s+into|delete\\s+from)\\b') OR regexp_matches(text, '(?i)javascript:') OR regexp_matches(text, '\\.\\./') AS unsafe,
trim(regexp_replace(regexp_replace(text, '\\[\\d+\\]|#\\d+|\\(\\d{1,3}\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS t, len(regexp_extract_all(text, '\\[\\d+\\]|#\\d+|\\(\\d{1,3}\\)'))::INT AS refs, CASE WHEN length(trim(text)) >= 40 AND (turn % 10) / 10.0 >= 0.2 THEN text ELSE '' END AS readable FROM conversations""")
def input_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    rows = table(spark, d, "conversations").withColumn("r", N.without_references(c))
    return rows.select("conv_id", "turn", D.unsafe_input(c, 2000).alias("unsafe"), F.col("r.text").alias("t"), F.size("r.refs").alias("refs"), V.readable(c, F.col("turn") % 10 / 10.0, 40, 0.2).alias("readable"))


@query("""SELECT item_id, regexp_replace(text, '(?i)\\b(the|und|les)\\b', '**\\1**', 'g') AS bold FROM benchmark""")
def highlighted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.highlighted(F.col("text"), ["the", "und", "les"]).alias("bold"))


@query("""SELECT p_name AS front, p_brand AS back, 'forward' AS kind FROM part UNION ALL SELECT p_brand, p_name, 'reverse' FROM part UNION ALL SELECT regexp_replace(p_name, '\\S', '_', 'g') || ' = ' || p_brand, p_name, 'gap' FROM part""")
def flashcards(spark: SparkSession, d: str) -> DataFrame:
    return X.flashcards(table(spark, d, "part"), "p_name", "p_brand")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') AND contains(p_name, 'bolt') THEN replace(p_name, 'bolt', 'BOLT') ELSE p_name END AS fixed FROM part""")
def rule_corrections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", N.rule_corrected(F.col("p_type"), F.col("p_name"), [("Steel", "bolt", "BOLT")]).alias("fixed"))


@query("""SELECT p_partkey, p_name AS back, len(regexp_extract_all(p_name, '(?i)old gear|rod|gear'))::INT AS found, regexp_matches(p_name, '(?i)old gear|rod|gear') AS marked FROM part""")
def placeholder_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", N.protected(F.col("p_name"), ["rod", "gear", "old gear"]).alias("p"))
    return rows.select("p_partkey", N.restored(F.col("p.text"), F.col("p.found")).alias("back"), F.size("p.found").alias("found"), F.col("p.text").contains("__MED_").alias("marked"))


@query("""SELECT doc_id, len(l)::INT AS lines, len(list_filter(l, lambda x: regexp_matches(x, '^[•\\-*○▪▸►]\\s+(.+)') OR regexp_matches(x, '^(\\d+)[.)]\\s+(.+)') OR regexp_matches(x, '^([A-Za-z\\x{0621}-\\x{064A}])[.)]\\s+(.+)')))::INT AS items FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", N.list_items(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("lines"), F.size(F.filter("l", lambda x: x.kind == "list_item")).alias("items"))


@query("""SELECT s_suppkey, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT s_suppkey, floor(abs(s_acctbal))::BIGINT % 3600 AS s FROM supplier)""")
def clock_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", E.clock(F.floor(F.abs("s_acctbal")) % 3600).alias("clock"))


_MIXED = pick(["نص عربي طويل جدا هنا مع Word", "English text only", "كلمة وكلمة اخرى و Two Words وايضا كلمات كثيرة", "123"], "p_partkey")


@query(f"""SELECT p_partkey, CASE WHEN a + e > 0 AND a / (a + e) > 0.7 THEN regexp_replace(t, '[A-Za-z0-9][A-Za-z0-9 .,:/_-]*[A-Za-z0-9]', chr(8206) || '\\0' || chr(8206), 'g') ELSE t END AS shown FROM (SELECT p_partkey, {_MIXED} AS t, len({_ALL}({_MIXED}, '[\\x{{0600}}-\\x{{06FF}}]')) AS a, len({_ALL}({_MIXED}, '[A-Za-z]')) AS e FROM part)""")
def rtl_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{_MIXED} AS t").select("p_partkey", N.rtl_display(F.col("t")).alias("shown"))


_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
_ROMAN = f"{pick(_TENS, '(p_size * 3 - p_size * 3 % 10) / 10')} || {pick(_ONES, '(p_size * 3)')}"


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_size * 3 % 100 > 0 THEN (p_size * 3 % 100)::INT END AS value FROM part""")
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh numeral has a letter too many."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_ROMAN} || CASE WHEN p_partkey % 7 = 0 THEN 'IIII' ELSE '' END AS t")
    return rows.select("p_partkey", N.roman_value(F.col("t")).alias("value"))


_PATH = "'in/' || p_brand || '\\\\..' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' : a?' ELSE '' END || '.' || " + pick(["PDF", "txt", "tar", "png", "xyz", "py", "mp3"], "p_partkey")


@query(f"""SELECT p_partkey, left(regexp_replace(regexp_replace(list_extract(regexp_split_to_array(p, '[/\\\\]'), -1), '[<>:"|?*]', '_', 'g'), '^\\.+', ''), 255) AS name,
CASE lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'document' WHEN 'txt' THEN 'text' WHEN 'tar' THEN 'archive' WHEN 'png' THEN 'image' WHEN 'py' THEN 'code' WHEN 'mp3' THEN 'audio' ELSE 'other' END AS kind
FROM (SELECT p_partkey, {_PATH.replace(chr(92) * 2, chr(92))} AS p FROM part)""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("p")
    return table(spark, d, "part").selectExpr("p_partkey", f"{_PATH} AS p").select("p_partkey", N.safe_filename(path).alias("name"), D.file_kind(path).alias("kind"))


@query(f"""SELECT p_partkey, array_to_string({_ALL}(t, '[\\x{{600}}-\\x{{6FF}}]+'), ' ') AS arabic, array_to_string({_ALL}(t, '[A-Za-z]+'), ' ') AS latin, array_to_string({_ALL}(t, '[0-9]+'), ' ') AS numbers
FROM (SELECT p_partkey, {_MIXED} || ' ' || p_size AS t FROM part)""")
def script_components(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_MIXED} || ' ' || p_size AS t").select("p_partkey", N.components(F.col("t")).alias("c"))
    return rows.select("p_partkey", "c.arabic", "c.latin", "c.numbers")


@query("""SELECT o_custkey, lang, count(*) AS runs, sum(len(w))::BIGINT AS tokens FROM (SELECT o_custkey, k, s, CASE WHEN o_orderkey % 3 = 0 THEN 'ar' WHEN o_orderkey % 3 = 1 THEN 'en' ELSE 'other' END AS lang, list(k) AS w FROM (
SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s, 1 AS k FROM (SELECT *, CASE WHEN lag(o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_orderkey % 3 THEN 0 ELSE 1 END AS fresh FROM orders)) GROUP BY ALL) GROUP BY o_custkey, lang""")
def language_runs(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a customer in turn, written as one Arabic word, one Latin word or one number each."""
    token = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'كلمة' WHEN 1 THEN 'word' ELSE '77' END")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", token.alias("w")))), lambda x: x.w), " ")
    runs = table(spark, d, "orders").groupBy("o_custkey").agg(line.alias("t")).select("o_custkey", F.explode(N.language_runs(F.col("t"))).alias("r"))
    return runs.groupBy("o_custkey", F.col("r.lang").alias("lang")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size(F.split("r.text", " "))).alias("tokens"))


@query("""SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_size % 3 >= 2 AND p_size % 2 = 1""")
def trusted_patterns(spark: SparkSession, d: str) -> DataFrame:
    patterns = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("image_hash"), F.lit("en").alias("language"), F.lit("w").alias("writer_id"), (F.col("p_size") % 3).alias("usage"), (F.col("p_size") % 2).alias("corrections"))
    return V.pattern_lookup(patterns, "Brand#1", "en", "w").select("p_partkey")


# --- features, samples, models


_TERMS = ["license", "version", "the", "und"]


@query(f"""SELECT doc_id, round(500.0 / 250, 6) AS aspect_ratio, length(text)::DOUBLE AS char_count, len(w)::DOUBLE AS word_count, round(len({_ALL}(text, '[!-/:-@\\[-`{{-~]'))::DOUBLE / greatest(length(text), 1), 6) AS punct_ratio, len(list_filter(['license', 'version', 'the', 'und'], lambda t: contains(lower(text), t)))::DOUBLE / 4 AS term_score,
30 AS n, 0.5 + 0.5 + 0.5 + 0.3 + 0.2 + 0.3 + 0.3 + 0.8 + 0.5 AS defaults FROM (SELECT doc_id, text, {_WORDS('text')} AS w FROM documents)""")
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumns({"width": F.lit(500), "height": F.lit(250)})
    got = M.feature_vector(docs, "text", _TERMS)
    at = {k: F.get("features", F.lit(i)) for i, k in enumerate(M.FEATURES)}
    fixed = [k for k, v in M.FEATURES.items() if v and k not in ("width", "height")]
    total = sum((at[k] for k in fixed), F.lit(0.0))
    return got.select("doc_id", *(at[k].alias(k) for k in ("aspect_ratio", "char_count", "word_count", "punct_ratio", "term_score")), F.size("features").alias("n"), F.round(total, 6).alias("defaults"))


@query("""SELECT vec_id, round(1 - (vec_id * 37 % 101) / 101.0, 6) AS margin FROM embeddings ORDER BY (vec_id * 37 % 101), vec_id LIMIT 30""")
def margin_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("confidence", F.col("vec_id") * 37 % 101 / 101.0)
    return C.margin_sample(rows, "vec_id", "confidence", 30).withColumn("margin", F.round("margin", 6))


@query("""SELECT user_id, n >= 60 OR days >= 5 AS train, CASE WHEN lo = 0 THEN hi <= 0.05 ELSE (hi - lo) / lo <= 0.5 END AS accept FROM (SELECT user_id, count(*) AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days, min(value) AS lo, avg(value) AS hi FROM events GROUP BY user_id)""")
def retrain_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.min("value").alias("lo"), F.avg("value").alias("hi"))
    return rows.select("user_id", C.should_train(F.col("n"), F.col("days"), 60, 5).alias("train"), C.accepts(F.col("lo"), F.col("hi"), 0.5).alias("accept"))


@query("""SELECT l.doc_id FROM labels l WHERE l.quality >= 1 AND l.toxic <= 0 AND l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def trainable_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("agreement"), (1 - F.col("toxic")).alias("confidence"))
    return C.trainable(rows, table(spark, d, "documents").where("lang = 'en'"), "doc_id", 1, 1).select("doc_id")


@query("""WITH e AS (SELECT label AS component, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), m AS (SELECT component, i, avg(v[i]) AS x FROM (SELECT component, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY ALL),
n AS (SELECT component, sqrt(sum(x * x)) AS norm FROM m GROUP BY component) SELECT component, round(max(x / norm), 6) AS top, round(sum(x * x / norm / norm), 6) AS one, count(*)::INT AS dims FROM m JOIN n USING (component) GROUP BY component""")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    got = U.centroids(e, e.select(F.col("vec_id").alias("node"), F.col("label").alias("component")), "vec_id", "embedding")
    return got.select("component", F.round(F.array_max("centroid"), 6).alias("top"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x), 6).alias("one"), F.size("centroid").alias("dims"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS r FROM (SELECT a.vec_id AS q, b.vec_id, b.label, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS d FROM b a JOIN b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE r <= 5)
SELECT q, least(greatest(round(sum(w * label) / sum(w)), 1.0), 8.0) AS label FROM (SELECT *, CASE WHEN d < 0.001 THEN 1000.0 ELSE 1 / d END AS w FROM n) GROUP BY q""")
def knn_regress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return L.knn_regress(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", {"label": (1.0, 8.0)}, 5)


@query("""SELECT l_orderkey, l_partkey % 4 AS page, arg_max(t, (l_discount * CASE e WHEN 'easyocr' THEN 0.95 WHEN 'trocr' THEN 0.88 ELSE 0.8 END, e, t)) AS text, string_agg(DISTINCT e, ' + ' ORDER BY e) AS engines FROM (SELECT *, l_returnflag || l_linenumber AS t, CASE l_linenumber % 3 WHEN 0 THEN 'easyocr' WHEN 1 THEN 'trocr' ELSE 'surya' END AS e FROM lineitem) GROUP BY ALL""")
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    engine = F.element_at(F.array(F.lit("easyocr"), F.lit("trocr"), F.lit("surya")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("page"), engine.alias("engine"), F.concat("l_returnflag", "l_linenumber").alias("text"), F.col("l_discount").alias("confidence"))
    return V.merged_pages(rows, "l_orderkey", "page", {"easyocr": 0.95, "trocr": 0.88}).select("l_orderkey", "page", "text", "engines")


@query("""SELECT o_custkey, arg_min(k, (-round(s, 9), k)) AS category, max(s)::DOUBLE AS confidence, floor(max(s)::DOUBLE / sum(s)::DOUBLE * 1000000)::BIGINT AS share FROM (SELECT o_custkey, o_orderpriority AS k, sum(o_orderkey % 100) AS s FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING sum(s) > 0""")
def classification_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 100).cast("double").alias("confidence"))
    got = V.classification_vote(rows, "o_custkey", "category", "confidence").where("share is not null")
    return got.select("o_custkey", "category", "confidence", F.floor(F.col("share") * 1_000_000).alias("share"))


@query("""SELECT l_orderkey, CASE WHEN sum(n) >= 3 THEN arg_max(t, (n, c, t)) ELSE arg_max(t, (c, t)) END AS text FROM (SELECT l_orderkey, l_returnflag AS t, count(*) AS n, max(l_discount) AS c FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def voted_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("engine"), F.col("l_returnflag").alias("text"), F.col("l_discount").alias("confidence"))
    return V.fused_lines(rows, "l_orderkey", "voting", {}).select("l_orderkey", "text")


@query("""SELECT l_orderkey, arg_max(l_returnflag, (l_discount * w, l_linestatus, l_returnflag)) AS text, round(sum(l_discount * w) / sum(w), 6) AS confidence FROM (SELECT *, CASE l_linestatus WHEN 'F' THEN 0.9 ELSE 0.8 END AS w FROM lineitem) GROUP BY l_orderkey""")
def weighted_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("engine"), F.col("l_returnflag").alias("text"), F.col("l_discount").alias("confidence"))
    return V.fused_lines(rows, "l_orderkey", "weighted_average", {"F": 0.9, "O": 0.8}).withColumn("confidence", F.round("confidence", 6))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b) AS r, a, b FROM (SELECT DISTINCT l_orderkey, (l_linenumber * 5 % 17)::INT AS a, (l_linenumber * 5 % 17 + l_quantity % 7 + 1)::INT AS b FROM lineitem)),
g AS (SELECT k, r, a, b, true AS keep, b AS till FROM s WHERE r = 1 UNION ALL SELECT s.k, s.r, s.a, s.b, s.a >= till, CASE WHEN s.a >= till THEN s.b ELSE till END FROM g JOIN s ON s.k = g.k AND s.r = g.r + 1)
SELECT k AS l_orderkey, a AS start, b AS stop FROM g WHERE keep""")
def greedy_spans(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("l_linenumber") * 5 % 17).cast("int")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(at.alias("start"), (at + F.col("l_quantity") % 7 + 1).cast("int").alias("end")).alias("s")).distinct()
    kept = rows.groupBy("l_orderkey").agg(D.greedy_spans(F.collect_list("s")).alias("k"))
    return kept.select("l_orderkey", F.explode("k").alias("x")).select("l_orderkey", "x.start", F.col("x.end").alias("stop"))


# --- events


@query("""SELECT event_id, subscriber FROM events JOIN (SELECT c_custkey // 10 AS tenant, c_custkey AS subscriber, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey * 7 % 700 AS INTEGER)) AS seen FROM customer) ON tenant = user_id WHERE epoch_us(ts) - epoch_us(seen) BETWEEN 0 AND 86400000000""")
def tenant_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A user is the tenant of ten customers, so fan-out grows with the events."""
    seen = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(c_custkey * 7 % 700 as int))")
    subscribers = table(spark, d, "customer").select(F.expr("c_custkey div 10").alias("tenant"), F.col("c_custkey").alias("subscriber"), seen.alias("seen"))
    events = windows.event_time(table(spark, d, "events")).withColumn("tenant", F.col("user_id"))
    return windows.fan_out(events, subscribers, "tenant", 86_400).select("event_id", "subscriber")


@query("""WITH s AS (SELECT user_id, max(epoch_us(ts)) + 1800000000 AS end_us, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, s) SELECT * FROM s WHERE end_us <= epoch_us(TIMESTAMP '2024-01-05')""")
def debounced(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.unix_micros(F.lit("2024-01-05").cast("timestamp"))
    return windows.settled(windows.event_time(table(spark, d, "events")), "user_id", "30 minutes", as_of).select("user_id", "end_us", "n")


@query("""SELECT DISTINCT l_orderkey, CASE WHEN q < 0.5 AND p = 'fast' THEN 'tesseract,easyocr' WHEN p = 'fast' THEN 'tesseract,easyocr' WHEN l = 'ar' AND q < 0.5 THEN 'surya,easyocr,tesseract' WHEN q < 0.5 THEN 'trocr,surya,paddleocr' ELSE 'surya,trocr,paddleocr' END AS engines FROM (
SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'fast' ELSE 'best' END AS p, CASE l_linestatus WHEN 'F' THEN 'ar' ELSE 'en' END AS l, l_discount * 10 AS q FROM lineitem)""")
def routed_engines(spark: SparkSession, d: str) -> DataFrame:
    profile, lang = F.when(F.col("l_returnflag") == "A", "fast").otherwise("best"), F.when(F.col("l_linestatus") == "F", "ar").otherwise("en")
    return table(spark, d, "lineitem").select("l_orderkey", F.array_join(D.routed_engines(profile, lang, F.col("l_discount") * 10), ",").alias("engines")).distinct()


# --- files: written by a sink and read back by a source


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(event_id AS VARCHAR) AS image_id, event_type || ', "' || user_id || '"' AS original_text, props AS corrected_text FROM events""")
def feedback_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _at(spark, "feedback")
    rows = table(spark, d, "events").select(F.col("ts").cast("string").alias("timestamp"), F.col("event_id").cast("string").alias("image_id"), F.concat("event_type", F.lit(', "'), "user_id", F.lit('"')).alias("original_text"), F.col("props").alias("corrected_text"), F.lit("new").alias("status"))
    X.write_csv(rows, path, escape='"')
    return readers.feedback_csv(spark, path).select("image_id", "original_text", "corrected_text")


@query("""SELECT conv_id, turn, text FROM conversations""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _at(spark, "json")
    X.append_log(table(spark, d, "conversations").where("turn % 2 = 0"), path)
    X.append_log(table(spark, d, "conversations").where("turn % 2 = 1"), path)
    return readers.json_lines(spark, path, "conv_id long, turn long, text string")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS tu_id, p_name AS source_text, 'fr ' || p_name AS target_text FROM part""")
def memory_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _at(spark, "tmx")
    unit = lambda lang, seg: F.struct(F.lit(lang).alias("_lang"), seg.alias("seg"))
    X.write_xml(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_tuid"), F.array(unit("en", F.col("p_name")), unit("fr", F.concat(F.lit("fr "), "p_name"))).alias("tuv")), path)
    return readers.translation_memory(spark, path, "en", "fr").select("tu_id", "source_text", "target_text")


@query("""SELECT p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand""")
def split_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _at(spark, "split")
    X.write_split(table(spark, d, "part"), path, "p_brand")
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("""SELECT p_name AS term, p_type || ' [' || p_brand || ']' AS definition FROM part""")
def dictionary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _at(spark, "dictionary")
    table(spark, d, "part").select(F.concat("p_name", F.lit("\t"), "p_type", F.lit(" ["), "p_brand", F.lit("]"))).write.text(path)
    return readers.dictionary_lines(spark, path)


@query("""SELECT s_suppkey, s_name AS back, true AS hidden FROM supplier""")
def encrypted_round_trip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit(b"0123456789abcdef")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", X.encrypted(F.col("s_name"), key).alias("e"))
    return rows.select("s_suppkey", X.decrypted(F.col("e"), key).alias("back"), (F.col("e") != F.col("s_name")).alias("hidden"))
