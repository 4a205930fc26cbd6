"""Queries over the star schema: views, filters, joins, ranking, paging, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import aggregates as A
from lexforge.operators import relational as R
from lexforge.plans.base import query
from lexforge.session import table


@query("""SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS avg_chars, max(n_chars) AS max_chars
FROM documents GROUP BY lang, source""")
def doc_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.max("n_chars").alias("max_chars")).orderBy(F.desc("n"), "lang", "source")


@query("""SELECT event_type AS engine, count(*) AS documents, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value
FROM events GROUP BY event_type""")
def engine_performance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("engine")).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.max("value"), 6).alias("max_value"))


@query("""SELECT 'brand' AS kind, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY event_type""")
def group_counts_desc(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").groupBy(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    kinds = table(spark, d, "events").groupBy(F.lit("event").alias("kind"), F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return parts.unionAll(kinds).orderBy(F.desc("n"), "kind", "value")


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_corrections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey),
l AS (SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_terms, coalesce(l.n, 0) AS n_corrections, c_acctbal > 0 AS is_active
FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN l ON l.k = c_custkey""")
def dictionary_stats(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per_order = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    both = per_order.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_corrections"))
    got = R.lookup_left(table(spark, d, "customer"), both, ["c_custkey"], {"n_terms": 0, "n_corrections": 0})
    return got.select("c_custkey", "c_name", "n_terms", "n_corrections", (F.col("c_acctbal") > 0).alias("is_active"))


@query("""SELECT p_brand AS category, count(*) AS n, round(avg(p_size), 6) AS avg_frequency, count(DISTINCT p_type) AS n_dicts
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_brand is not null").groupBy(F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_size"), 6).alias("avg_frequency"), F.count_distinct("p_type").alias("n_dicts")).orderBy(F.desc("n"), "category")


@query("""SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR starts_with(p_name, 'hot')""")
def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").startswith("small") | F.col("p_name").startswith("hot")).select("p_partkey", "p_name")


@query("""SELECT doc_id, quality, toxic FROM labels WHERE quality < 1 AND toxic >= 0""")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.filtered(table(spark, d, "labels"), at_least={"toxic": 0}).where("quality < 1").select("doc_id", "quality", "toxic")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'""")
def in_set_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.filtered(table(spark, d, "orders"), equals={"o_orderpriority": "1-URGENT"}, among={"o_orderstatus": ["F", "P"]}).select("o_orderkey", "o_orderstatus")


@query("""SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def labeled_docs_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT doc_id, lang FROM documents x WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id)""")
def pending_docs_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2""")
def having_fixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def keep_best(spark: SparkSession, d: str) -> DataFrame:
    got = R.top_per_key(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return got.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("""SELECT user_id, event_type, event_id FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("""SELECT o_custkey, min(pos) AS position FROM (
SELECT o_custkey, o_orderkey AS pos FROM orders) GROUP BY o_custkey""")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("position"))


@query("""SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    # nation and region are fixed lookup tables of 25 and 5 rows
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return R.lookup_left(table(spark, d, "supplier"), places, ["s_nationkey"], {"nation": "unknown", "region": "unknown"}).select("s_suppkey", "s_name", "nation", "region")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)
UNION ALL SELECT 'union_all', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    frames = {"union": s.union(c).distinct(), "union_all": s.unionAll(c), "intersect": s.intersect(c), "except": n.subtract(s)}
    out = None
    for name, f in frames.items():
        row = f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("""SELECT k, source FROM (SELECT k, source, row_number() OVER (PARTITION BY k ORDER BY source) AS r FROM (
SELECT DISTINCT s_nationkey AS k, 'a_supplier' AS source FROM supplier UNION ALL SELECT DISTINCT c_nationkey, 'b_customer' FROM customer)) WHERE r = 1""")
def merge_by_priority(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("a_supplier").alias("source")).distinct()
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("b_customer").alias("source")).distinct()
    return R.merge_prioritised([a, b], ["k"]).select("k", "source")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open,
count(*) FILTER (o_orderstatus = 'P') AS pending, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS before_avg,
round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS after_avg FROM orders""")
def image_stats(spark: SparkSession, d: str) -> DataFrame:
    s, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, d, "orders").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("pending"),
        F.round(F.avg(F.when(s == "O", price)), 2).alias("before_avg"), F.round(F.avg(F.when(s == "F", price)), 2).alias("after_avg"),
    )


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50""")
def review_page(spark: SparkSession, d: str) -> DataFrame:
    rows = R.filtered(table(spark, d, "orders"), equals={"o_orderstatus": "O"}).select("o_orderkey", "o_totalprice")
    return R.page(rows, [F.col("o_totalprice"), F.col("o_orderkey")], 3, 25)


@query("""SELECT o_custkey, count(*) AS violations FROM (
SELECT o_custkey, o_orderdate > lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bad FROM orders) WHERE bad GROUP BY o_custkey""")
def temporal_violations(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").withColumn("bad", F.col("o_orderdate") > nxt).where("bad").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("violations"))


@query("""SELECT l_orderkey, line, string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS words, round(max(l_quantity), 6) AS y FROM (
SELECT *, sum(brk) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM (
SELECT *, CASE WHEN l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) > 5 THEN 1 ELSE 0 END AS brk FROM lineitem))
GROUP BY l_orderkey, line""")
def line_grouping(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.layout import grouped_lines

    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y"), F.col("l_linenumber").alias("x"), "l_partkey", "l_suppkey")
    got = grouped_lines(lines, ["l_orderkey"], "y", ["x", "l_partkey", "l_suppkey"], 5)
    word = F.array_sort(F.collect_list(F.struct("x", "l_partkey", "l_suppkey")))
    return got.groupBy("l_orderkey", "line").agg(F.array_join(F.transform(word, lambda w: w.x.cast("string")), " ").alias("words"), F.round(F.max("y"), 6).alias("y"))


@query("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_quantity, -l_linenumber, l_partkey, l_suppkey) AS rtl,
string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS ltr FROM lineitem GROUP BY l_orderkey""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    rtl = F.array_sort(F.collect_list(F.struct("l_quantity", (-F.col("l_linenumber")).alias("x"), "l_partkey", "l_suppkey")))
    ltr = F.array_sort(F.collect_list(F.struct("l_quantity", F.col("l_linenumber").alias("x"), "l_partkey", "l_suppkey")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(rtl, lambda w: (-w.x).cast("string")), " ").alias("rtl"), F.array_join(F.transform(ltr, lambda w: w.x.cast("string")), " ").alias("ltr"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
g AS (SELECT l_orderkey, r, y, y AS anchor, 1 AS row_no FROM o WHERE r = 1
UNION ALL SELECT o.l_orderkey, o.r, o.y, CASE WHEN abs(o.y - g.anchor) >= 10 THEN o.y ELSE g.anchor END, CASE WHEN abs(o.y - g.anchor) >= 10 THEN g.row_no + 1 ELSE g.row_no END
FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.r = g.r + 1)
SELECT l_orderkey, max(row_no)::BIGINT AS n_rows, count(*) AS n_words FROM g GROUP BY l_orderkey""")
def row_grouping_anchor(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.layout import anchored_rows

    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity"))).alias("ys"))
    return rows.select("l_orderkey", F.size(anchored_rows(F.col("ys"), 10.0)).cast("long").alias("n_rows"), F.size("ys").cast("long").alias("n_words"))


@query("""SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL""")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_type is not null").select("p_type").distinct().orderBy("p_type")


@query("""SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM part WHERE p_size > 25) AS large, (SELECT count(DISTINCT p_brand) FROM part) AS brands,
round((SELECT sum(p_retailprice) FROM part), 2) AS total, round((SELECT avg(p_retailprice) FROM part WHERE p_retailprice > 0), 6) AS mean""")
def scalar_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_distinct("p_brand").alias("brands"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.round(F.avg(F.when(F.col("p_retailprice") > 0, F.col("p_retailprice"))), 6).alias("mean"))


@query("""SELECT p_brand, round(min(p_retailprice), 6) AS lo_price, round(max(p_retailprice), 6) AS hi_price, min(p_size) AS lo_size, max(p_size) AS hi_size FROM part GROUP BY p_brand""")
def min_max_fit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.min("p_retailprice"), 6).alias("lo_price"), F.round(F.max("p_retailprice"), 6).alias("hi_price"), F.min("p_size").alias("lo_size"), F.max("p_size").alias("hi_size"))


@query("""SELECT p_brand, CAST(json_object('n', count(*), 'first', min(p_name)) AS VARCHAR) AS entry FROM part GROUP BY p_brand""")
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first"))).alias("entry"))


@query("""SELECT c_custkey, coalesce(n, 0) AS frequency FROM customer FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) ON k = c_custkey""")
def upsert_frequency(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("frequency"))
    return R.upsert_counts(have, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3 UNION ALL
SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 3""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), "n_regionkey")
    return R.insert_or_ignore(n.where("n_regionkey < 3").drop("n_regionkey"), n.drop("n_regionkey"), ["k"], [F.col("name")])


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
AND abs(date_diff('second', date_trunc('second', a.ts), date_trunc('second', b.ts))) <= 300""")
def near_in_time(spark: SparkSession, d: str) -> DataFrame:
    got = R.near_in_time(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 300)
    return got.where("a.event_id < b.event_id").select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS id, l_linenumber * 10.0 AS x, l_quantity AS y, 15.0 AS w, 10.0 AS h, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT a.page, a.id AS id_a, b.id AS id_b, round(ix * iy / (a.w * a.h + b.w * b.h - ix * iy), 6) AS iou FROM (
SELECT a, b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) AS ix, greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS iy
FROM l a JOIN l b ON a.page = b.page AND a.id < b.id AND abs(a.x - b.x) < 15 AND abs(a.y - b.y) < 10) WHERE ix * iy / (a.w * a.h + b.w * b.h - ix * iy) > 0.1""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.layout import overlapping

    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 10.0).alias("x"), F.col("l_quantity").alias("y"), F.lit(15.0).alias("w"), F.lit(10.0).alias("h"))
    return overlapping(boxes, ["page"], "id", 0.1).select("page", "id_a", "id_b", F.round("iou", 6).alias("iou"))


@query("""SELECT dimension, value, n FROM (SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority)""")
def order_counters(spark: SparkSession, d: str) -> DataFrame:
    return A.counters(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), ["status", "priority"])
