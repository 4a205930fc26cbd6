"""Queries on notes: medical extraction and checks, merge safety, vocabulary. Notes are made from orders.

The driver tables hold no medical or Arabic prose, so a note is an expression over an order's key
that Spark and SQL both compute; every order has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import detect as D
from lexforge.functions import normalize as N
from lexforge.operators import curate as C
from lexforge.operators import medical as M
from lexforge.operators import review as V
from lexforge.plans.base import query
from lexforge.session import table


def pick(items: list[str], key: str = "o_orderkey") -> str:
    """SQL of both engines for the item that the key's remainder names."""
    return "CASE " + f"{key} % {len(items)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


CONDITIONS = ["severe asthma", "mild knee pain", "chronic heart failure", "a fracture of the left wrist", "type two diabetis", "acute spine infection and right left mismatch"]
NOTE = " || ".join([
    "'Patient was diagnosed with '", pick(CONDITIONS), "'. He was given '", pick(["Amoxicillin", "Ibuprofen", "Metformin", "Lisinopril", "Aspirin", "Warfarin with aspirin", "Atorvastatin"]), "' '",
    pick(["5", "100", "250", "500", "1000"]), "' mg for '", pick(["infection", "pain", "fever", "pressure"]), "'. '", pick(["Surgery", "Biopsy", "An MRI"]), "' was performed on the '",
    pick(["knee", "hip", "liver", "wrist"]), "' on 2024-0'", "(1 + o_orderkey % 9)", "'-1'", "(o_orderkey % 10)", "' at '", pick(["Central Hospital", "Green Valley Clinic", "State University", "home"]),
    "' by Dr. '", pick(["Lee", "Mary Stone", "Okafor"]), "'. Elevated pulse in morning BID.'", pick(["", " تشخيص: كسر.", " المريض مصاب بـ ربو.", "", " عملية جراحية"]),
])


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """A note per order; explode keeps Spark from writing the note's expression into every use of it."""
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", f"explode(array({NOTE})) AS text")


_NOTES = f"(SELECT o_orderkey, o_custkey, {NOTE} AS text FROM orders)"
_ALL = "regexp_extract_all"


def _quoted(p: str) -> str:
    return p.replace("'", "''")


def _entity_rows() -> str:
    """A diagnosis, of highest priority, takes the words that it covers from the others."""
    rest = f"(SELECT o_orderkey, text, regexp_replace(text, '{_quoted(M.ENTITIES[0][1])}', '#', 'g') AS rest FROM {_NOTES})"
    parts = [f"SELECT o_orderkey, '{k}' AS kind, unnest({_ALL}({'text' if i == 0 else 'rest'}, '{_quoted(p)}')) AS value FROM {rest}" for i, (k, p) in enumerate(M.ENTITIES)]
    return " UNION ALL ".join(parts)


@query(_entity_rows())
def medical_entities(spark: SparkSession, d: str) -> DataFrame:
    return M.entities(_notes(spark, d), "o_orderkey", "text").select("o_orderkey", "kind", "value")


@query(f"SELECT o_orderkey, kind, array_to_string(list_sort(list_distinct(list(value))), '|') AS entries FROM ({_entity_rows()}) GROUP BY o_orderkey, kind")
def entities_by_kind(spark: SparkSession, d: str) -> DataFrame:
    got = M.by_kind(M.entities(_notes(spark, d), "o_orderkey", "text"), "o_orderkey")
    return got.withColumn("entries", F.array_join("entries", "|"))


def _relation_rows() -> str:
    one = lambda name, p: f"SELECT o_orderkey, unnest({_ALL}(text, '{p}', 1)) AS s, '{name}' AS relation, unnest({_ALL}(text, '{p}', 2)) AS o FROM {_NOTES}"
    return "SELECT o_orderkey, lower(trim(s)) AS subject, relation, lower(trim(o)) AS object FROM (" + " UNION ALL ".join(one(n, _quoted(p)) for n, p in M.RELATIONS) + ")"


@query(f"""WITH k AS (SELECT o_orderkey, lower(trim(value)) AS value, min(kind) AS kind FROM ({_entity_rows()}) GROUP BY ALL)
SELECT r.o_orderkey, subject, relation, object, a.kind AS subject_kind, b.kind AS object_kind FROM ({_relation_rows()}) r LEFT JOIN k a ON a.o_orderkey = r.o_orderkey AND a.value = subject LEFT JOIN k b ON b.o_orderkey = r.o_orderkey AND b.value = object""")
def medical_relations(spark: SparkSession, d: str) -> DataFrame:
    got = M.grounded_relations(_notes(spark, d), "o_orderkey", "text")
    return got.select("o_orderkey", "subject", "relation", "object", "subject_kind", "object_kind")


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, unnest({_ALL}(text, '{_quoted(p)}')) AS value FROM {_NOTES}" for k, p in (("PERSON", M.PERSON), ("ORGANIZATION", M.ORGANISATION), ("DATE", M.ENTITIES[4][1]))))
def named_entities(spark: SparkSession, d: str) -> DataFrame:
    return M.names(_notes(spark, d), "o_orderkey", "text").select("o_orderkey", "kind", "value")


_DRUGS = sorted({*D.DOSES, *(x for pair in D.INTERACTIONS for x in pair)})
_HAS = lambda c, xs: f"list_filter([{', '.join(chr(39) + x + chr(39) for x in xs)}], lambda w: contains(lower({c}), w))"
_DOSE = " + ".join(f"len(list_filter({_ALL}(text, '(?i){n}.{{0,50}}?\\b{D.DOSAGE}', 1), lambda a: a::DOUBLE {op} {v}))" for n, (lo, hi) in D.DOSES.items() for op, v in (("<", lo), (">", hi)))
_LOWS, _HIGHS = (" + ".join(f"len(list_filter({_ALL}(text, '(?i){n}.{{0,50}}?\\b{D.DOSAGE}', 1), lambda a: a::DOUBLE {op} {v[i]}))" for n, v in D.DOSES.items()) for i, op in ((0, "<"), (1, ">")))
_PAIRS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{a}') AND contains(lower(text), '{b}') THEN '{'+'.join(sorted((a, b)))}' END" for a, b in D.INTERACTIONS) + "], lambda p: p IS NOT NULL)"


@query(f"""SELECT o_orderkey, drugs, interactions, (lows + highs)::INT AS dose_errors, round(CASE WHEN lows + highs + n = 0 THEN 0.95 ELSE greatest(0.3, 1 - 0.15::DOUBLE * lows - 0.3::DOUBLE * highs - 0.5::DOUBLE * n) END::DOUBLE, 6) AS confidence FROM (
SELECT o_orderkey, array_to_string({_HAS('text', _DRUGS)}, ',') AS drugs, array_to_string({_PAIRS}, ',') AS interactions, len({_PAIRS}) AS n, {_LOWS} AS lows, {_HIGHS} AS highs FROM {_NOTES})""")
def drug_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    found = F.struct(D.drugs(c).alias("drugs"), D.interactions(c).alias("pairs"), D.dose_issues(c).alias("issues"))

    def checked(x: Column) -> Column:
        levels = F.concat(F.transform(x.issues, lambda y: y.level), F.transform(x.pairs, lambda y: F.lit("CRITICAL")))
        return F.struct(F.array_join(x.drugs, ",").alias("drugs"), F.array_join(x.pairs, ",").alias("interactions"), F.size(x.issues).alias("dose_errors"), F.round(D.validator_confidence(levels), 6).alias("confidence"))

    got = _notes(spark, d).select("o_orderkey", N.bound(found, checked).alias("x"))
    return got.select("o_orderkey", "x.drugs", "x.interactions", "x.dose_errors", "x.confidence")


FINDINGS = ["fracture of the right wrist", "fracture of the left wrist", "mild pain in the knee", "severe pain in the shoulder", "كسر مغلق أيمن حاد", "كسر مفتوح أيسر مزمن", "no change since", "acute open fracture of the spine"]
_WORDS = {k: _HAS("{c}", words) for k, (_, words) in D.PROTECTED.items()}
_CLASH = lambda k: f"CASE WHEN len({_WORDS[k].format(c='a')}) > 0 AND len({_WORDS[k].format(c='b')}) > 0 AND list_sort(list_distinct({_WORDS[k].format(c='a')})) <> list_sort(list_distinct({_WORDS[k].format(c='b')})) THEN '{k}' END"


@query(f"""SELECT o_orderkey, array_to_string(c, ',') AS conflicts, CASE WHEN list_contains(c, 'laterality') OR list_contains(c, 'fracture_type') THEN 'critical' WHEN list_contains(c, 'severity') THEN 'high' WHEN len(c) > 0 THEN 'medium' ELSE 'none' END AS level FROM (
SELECT o_orderkey, list_filter([{', '.join(_CLASH(k) for k in D.PROTECTED)}], lambda x: x IS NOT NULL) AS c FROM (
SELECT o_orderkey, {pick(FINDINGS)} AS a, lead({pick(FINDINGS)}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)""")
def merge_safety(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", f"{pick(FINDINGS)} AS a")
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("b is not null")
    got = rows.select("o_orderkey", D.merge_conflicts(F.col("a"), F.col("b")).alias("c"))
    return got.select("o_orderkey", F.array_join("c", ",").alias("conflicts"), D.merge_severity(F.col("c")).alias("level"))


@query(f"""SELECT o_orderkey, {', '.join(f"len({_ALL}(text, '{_quoted(p)}'))::INT AS {k}" for k, p in D.CRITICAL.items())}, len({_ALL}(text, '(?i){D.DOSAGE}'))::INT AS dosages,
list_sum(list_transform({_ALL}(text, '(?i){D.DOSAGE}', 1), lambda a: a::DOUBLE)) AS amount, array_to_string(list_transform({_ALL}(text, '(?i){D.DOSAGE}', 2), lambda u: lower(u)), ',') AS units FROM {_NOTES}""")
def critical_content(spark: SparkSession, d: str) -> DataFrame:
    rows = _notes(spark, d).select("o_orderkey", D.critical_content(F.col("text")).alias("m"), D.dosages(F.col("text")).alias("x"))
    counts = [F.size(F.col("m")[k]).alias(k) for k in D.CRITICAL]
    amount = F.aggregate("x", F.lit(0.0), lambda s, e: s + e.amount)
    return rows.select("o_orderkey", *counts, F.size("x").alias("dosages"), F.when(F.size("x") > 0, amount).alias("amount"), F.array_join(F.transform("x", lambda e: e.unit), ",").alias("units"))


_DIFFER = " OR ".join([*(f"len({_ALL}(a, '{p}')) <> len({_ALL}(b, '{p}'))" for p in map(_quoted, D.CRITICAL.values())), *(f"{_ALL}(a, '{_quoted(D.CRITICAL[k])}') <> {_ALL}(b, '{_quoted(D.CRITICAL[k])}')" for k in ("dosage", "lab_value"))])


@query(f"""SELECT o_orderkey, CASE WHEN s >= 0.85 AND NOT differ THEN 'AUTO_ACCEPT' WHEN s < 0.6 OR differ THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'QUICK_CHECK' END AS decision FROM (
SELECT o_orderkey, (50 + o_orderkey % 50) / 100.0 AS s, {_DIFFER} AS differ FROM (SELECT o_orderkey, text AS a, CASE WHEN o_orderkey % 3 = 0 THEN replace(text, '5', '6') ELSE text END AS b FROM {_NOTES}))""")
def dual_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = _notes(spark, d).withColumn("b", F.when(F.col("o_orderkey") % 3 == 0, F.replace("text", F.lit("5"), F.lit("6"))).otherwise(F.col("text")))
    similarity = (50 + F.col("o_orderkey") % 50) / 100.0
    return rows.select("o_orderkey", D.dual_decision(similarity, F.col("text"), F.col("b")).alias("decision"))


_CATEGORIES = {k: f"len({_ALL}(text, '{_quoted(p)}'))" for k, p in M.CATEGORIES.items()}


@query(f"""SELECT o_orderkey, CASE WHEN greatest({', '.join(_CATEGORIES)}) = 0 THEN 'general' {' '.join(f"WHEN {k} = greatest({', '.join(_CATEGORIES)}) THEN '{k}'" for k in _CATEGORIES)} END AS category,
array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(text), '{w}') AND NOT contains(lower(text), '{r}') THEN '{w}' END" for w, r in M.TYPOS.items())}], lambda x: x IS NOT NULL), ',') AS misspelled,
len(list_filter(string_split(lower(text), '.'), lambda s: regexp_matches(s, '\\bright\\b') AND regexp_matches(s, '\\bleft\\b')))::INT AS both_sides,
round(least(1.0, 0.5 + CASE WHEN length(text) < 30 THEN 0.2 WHEN length(text) < 60 THEN 0.1 ELSE 0 END + least(0.1 * ({' + '.join(_CATEGORIES)}), 0.3))::DOUBLE, 6) AS confidence FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _CATEGORIES.items())} FROM {_NOTES})""")
def note_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    got = _notes(spark, d).select("o_orderkey", M.classified(c).alias("x"), F.array_join(M.misspellings(c), ",").alias("misspelled"), D.laterality_conflicts(c).alias("both_sides"))
    return got.select("o_orderkey", "x.category", "misspelled", "both_sides", F.round("x.confidence", 6).alias("confidence"))


_PAIR = "p_name || " + pick([" | عظم", "", " - مفصل الركبة", " : قلب"], "p_partkey")


@query(f"""SELECT p_partkey, english, arabic FROM (SELECT p_partkey, array_to_string({_ALL}({_PAIR}, '[A-Za-z]+'), ' ') AS english, array_to_string({_ALL}({_PAIR}, '[\\x{{0600}}-\\x{{06FF}}]+'), ' ') AS arabic FROM part) WHERE english <> '' AND arabic <> ''""")
def vocabulary_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.bilingual_pairs(table(spark, d, "part").selectExpr("p_partkey", f"{_PAIR} AS t"), "p_partkey", "t")


TOKENS = ["بيت", "نيت", "ثيب", "xyz", "جبر", "دار", "ذار", "سور"]
WORDS = ["بيت", "بنت", "خبر", "حبر", "دار", "شور"]
_GROUPS = ", ".join(f"('{g}')" for g in V.DOTTED)


@query(f"""WITH k AS (SELECT DISTINCT {pick(TOKENS, 'p_partkey')} || CASE WHEN p_size > 25 THEN '' ELSE 'ا' END AS token FROM part), v AS (SELECT {pick(WORDS, 'p_size')} AS word, count(*) AS frequency FROM part GROUP BY ALL),
p AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM k), g AS (SELECT unnest(string_split(g, '')) AS ch, g FROM (VALUES {_GROUPS}) t(g)),
t AS (SELECT token, substr(token, 1, i - 1) || unnest(string_split(g, '')) || substr(token, i + 1) AS word FROM p JOIN g ON ch = substr(token, i, 1) UNION SELECT token, token FROM k),
b AS (SELECT token, arg_max(word, (word = token, frequency, word)) AS word FROM t JOIN v USING (word) GROUP BY token)
SELECT k.token, coalesce(b.word, k.token) AS word FROM k LEFT JOIN b USING (token)""")
def dotted_recovery(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    tokens = parts.selectExpr(f"{pick(TOKENS, 'p_partkey')} || CASE WHEN p_size > 25 THEN '' ELSE 'ا' END AS token")
    vocabulary = parts.selectExpr(f"{pick(WORDS, 'p_size')} AS word").groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    return V.recovered(tokens, vocabulary, "token")


_ARABIC = pick(["مُحَمَّد  إلى المدرسة", "إسلام آمن أحمد", "كـــتاب، جديد!", "ذهبَ الولدُ", "Mixed نصّ 12"], "p_partkey") + " || ' ' || p_name"
_MARKS = "[\\x{064B}-\\x{065F}\\x{0670}]"


@query(f"""SELECT p_partkey, trim(regexp_replace(t, '{_MARKS}', '', 'g')) AS sanitised, trim(regexp_replace(translate(regexp_replace(t, '{_MARKS}', '', 'g'), 'إأٱى', 'اااي'), '\\s+', ' ', 'g')) AS evaluation,
trim(regexp_replace(lower(regexp_replace(translate(regexp_replace(t, '{_MARKS}|ـ', '', 'g'), 'إأٱآىة', 'اااايه'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), '\\s+', ' ', 'g')) AS comparison, regexp_matches(t, '{_MARKS}') AS marked,
trim(regexp_replace(regexp_replace(regexp_replace(t, '([\\x{{0600}}-\\x{{06FF}}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{{0600}}-\\x{{06FF}}])', '\\1 \\2', 'g'), ' {{2,}}', ' ', 'g')) AS spaced,
array_to_string({_ALL}(t, '[\\x{{0600}}-\\x{{06FF}}]+'), ' ') AS arabic, array_to_string({_ALL}(t, '[A-Za-z]+'), ' ') AS latin FROM (SELECT p_partkey, {_ARABIC} AS t FROM part)""")
def arabic_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("t")
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_ARABIC} AS t").withColumn("x", N.components(c))
    return rows.select("p_partkey", N.sanitised_label(c).alias("sanitised"), N.evaluation(c).alias("evaluation"), N.comparison(c).alias("comparison"), N.has_diacritics(c).alias("marked"), N.mixed_spacing(c).alias("spaced"), "x.arabic", "x.latin")


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS i, list(text ORDER BY turn) FILTER (turn % 3 <> 2) AS o FROM conversations GROUP BY conv_id),
w AS (SELECT *, list_distinct(list_filter(flatten(list_transform(i, lambda t: regexp_split_to_array(lower(t), '\\s+'))), lambda x: x <> '')) AS iw, list_distinct(list_filter(flatten(list_transform(coalesce(o, []), lambda t: regexp_split_to_array(lower(t), '\\s+'))), lambda x: x <> '')) AS ow FROM c)
SELECT conv_id, round(CASE WHEN len(iw) > 0 THEN len(list_intersect(iw, ow))::DOUBLE / len(iw) ELSE 1.0 END, 6) AS recall, CASE WHEN len(i) < 2 THEN 1.0 WHEN list_contains(coalesce(o, []), i[1]) AND list_contains(coalesce(o, []), i[2]) THEN 1.0 ELSE 0.0 END::DOUBLE AS preserved FROM w""")
def dedup_safety(spark: SparkSession, d: str) -> DataFrame:
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", "text")))), lambda x: x.text)
    cases = table(spark, d, "conversations").groupBy("conv_id").agg(ordered(F.lit(True)).alias("input"), ordered(F.col("turn") % 3 != 2).alias("output"))
    pair = F.array(F.struct(F.get("input", F.lit(0)).alias("a"), F.get("input", F.lit(1)).alias("b")))
    cases = cases.withColumn("protected", F.when(F.size("input") > 1, pair).otherwise(F.slice(pair, 1, 0)))
    return V.dedup_safety(cases, "conv_id").withColumn("recall", F.round("recall", 6))


_VERSION = "'v' || (s_suppkey % 3) || '.' || (s_suppkey % 12) || '.' || (s_suppkey % 7)"


@query(f"""SELECT s_nationkey, arg_max(v, (score, k)) AS best, arg_max(v, k) AS newest, count(*) AS kept FROM (
SELECT s_nationkey, {_VERSION} AS v, floor(s_acctbal / 1000) AS score, [s_suppkey % 3, s_suppkey % 12, s_suppkey % 7] AS k FROM supplier) GROUP BY s_nationkey""")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "supplier").selectExpr("s_nationkey", f"{_VERSION} AS version", "floor(s_acctbal / 1000) AS score")
    key = C.version_key(F.col("version"))
    return models.groupBy("s_nationkey").agg(F.max_by("version", F.struct("score", key)).alias("best"), F.max_by("version", key).alias("newest"), F.count(F.lit(1)).alias("kept"))


_HITS = [f"len({_ALL}(text, '{_quoted(p)}'))" for p in M.CATEGORIES.values()]
_MOST = "CASE WHEN m = 0 THEN 'general' " + " ".join(f"WHEN n[{i + 1}] = m THEN '{k}'" for i, k in enumerate(M.CATEGORIES)) + " END"


@query(f"""SELECT o_orderkey, {_MOST} AS category, round(least(1.0, 0.5 + CASE WHEN length(text) < 30 THEN 0.2 WHEN length(text) < 60 THEN 0.1 ELSE 0 END + least(0.1 * list_sum(n), 0.3)), 6) AS confidence
FROM (SELECT *, list_max(n) AS m FROM (SELECT o_orderkey, text, [{', '.join(_HITS)}] AS n FROM {_NOTES}))""")
def note_categories(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    got = _notes(spark, d).select("o_orderkey", M.classified(c).alias("x"))
    return got.select("o_orderkey", "x.category", F.round("x.confidence", 6).alias("confidence"))
