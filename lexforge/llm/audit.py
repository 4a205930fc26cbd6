"""Filter interaction audit: what every order of the quality filters removes, step by step.

A text gets a mask with one bit per filter it fails; texts are read once and only the mask, the
text's digest and the ids go on. Rows are then counted per cell (part, mask, labels), the cells are
unpivoted against the steps of all orders, a running bit-or over the steps before names the earlier
failures, and conditional sums per (part, order, step) give the metrics. The window of a filter over
all orders gives its Shapley total.

Filters: A too few words, B too few distinct words, C too many capitals, D a symbol, E a text that a
smaller doc_id also has. Words are runs of characters other than space and tab to carriage return;
null and empty texts have no words, fail A, pass B, C and D, and equal one another. A null doc_id is
neither smaller nor larger than another. Repeated rows all count; rows of one doc_id and one text do
not fail E by one another. A doc_id that labels holds twice is good or toxic if one of its rows says
so; null labels and missing ones are neither. A null part is the empty string. An empty table gives
no rows. Other columns are not looked at, and long texts are read whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|]"
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
TWIN = BIT["E"]


def masks(rows: DataFrame, least_words: int = 200, distinct_pct: int = 50, capitals_pct: int = 3) -> DataFrame:
    """Rows with the column t replaced by mask, the bits of the filters A to D that the text fails."""
    found = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), 0))  # a projection of its own: words are cut once
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    fails = {"A": n < least_words, "B": 100 * distinct < distinct_pct * n, "C": 100 * F.regexp_count("t", F.lit("[A-Z]")) > capitals_pct * F.char_length("t"), "D": F.col("t").rlike(SYMBOL)}
    return found.withColumn("mask", sum((F.when(f, BIT[k]).otherwise(0) for k, f in fails.items()), F.lit(0))).drop("w", "t")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: how many rows share them.

    Rows of one text are counted per digest before the digests meet, so a text that a third of all
    rows hold is a few rows where its smallest doc_id is looked up.
    """
    text = F.coalesce("text", F.lit(""))
    facts = masks(docs.select("doc_id", text.alias("t"), F.sha2(text, 256).alias("digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")))
    rows = facts.groupBy("doc_id", "digest", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.join(marks, "doc_id", "left").select("doc_id", "digest", "mask", "part", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    has_id = F.col("doc_id").isNotNull()
    per = known.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("low"),
        F.min(F.when(has_id, F.struct("doc_id", "n")))["n"].alias("at_low"),
        F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("without"),
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    counted = per.withColumn("clear", F.when(F.col("low") == first, F.col("at_low")).otherwise(0) + F.col("without"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("clear").alias("c")), F.struct((F.col("mask") + TWIN).alias("m"), (F.col("n") - F.col("clear")).alias("c"))))
    split = counted.select("part", "good", "toxic", both.alias("b"))
    return split.where("b.c > 0").groupBy("part", F.col("b.m").alias("mask"), "good", "toxic").agg(F.sum("b.c").alias("n"))


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, bit: the five steps of each of the 120 orders, 600 rows whatever the input."""
    rows = [("".join(p), i, f, BIT[f]) for p in permutations(FILTERS) for i, f in enumerate(p, 1)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, bit int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    tests = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.col("mask").bitwiseAND(F.lit(BIT[f])).alias("hit")) for f in FILTERS)))
    unpivoted = cells(docs, labels, part).select("part", "mask", "good", "toxic", "n", tests.alias("t")).select("part", "mask", "good", "toxic", "n", "t.filter", "t.hit")
    dealt = unpivoted.join(F.broadcast(steps(docs.sparkSession)), "filter")  # 600 rows
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, fresh = F.col("hit") > 0, F.col("earlier") == 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    sums = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & fresh).alias("kept"),
        total(fails & fresh).alias("removed"),
        total(fails & ~fresh).alias("redundant"),
        total(fails & (F.col("mask") == F.col("bit"))).alias("unique_fails"),
        total(fails & fresh & (F.col("good") == 1)).alias("good_lost"),
        total(fails & fresh & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents, a part per language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_FAILS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')",
    "E": "doc_id > first_id",
}
_ORDERS = " UNION ALL ".join(f"SELECT '{''.join(p)}' AS filter_order, {i} AS step, '{f}' AS f, {BIT[f]} AS bit, {sum(BIT[x] for x in p[: i - 1])} AS before" for p in permutations(FILTERS) for i, f in enumerate(p, 1))

SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
s AS (SELECT *, len(words) AS n_words, len(list_distinct(words)) AS n_distinct FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {' + '.join(f"CASE WHEN {c} THEN {BIT[k]} ELSE 0 END" for k, c in _FAILS.items())} AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM s LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL), o AS ({_ORDERS}),
r AS (SELECT part, filter_order, step, f,
CAST(coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND good = 1), 0) AS BIGINT) AS good_lost,
CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND toxic = 1), 0) AS BIGINT) AS toxic_lost FROM c, o GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""
