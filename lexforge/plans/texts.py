"""Queries over documents, pages and conversations: normalisation, detection, PII, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import detect as D
from lexforge.functions import normalize as N
from lexforge.plans.base import query
from lexforge.session import table

#: A small lexicon for both classifiers over the driver's invented prose.
_START, _END = r"(?:^|[\s.,;:!?])", r"(?:[\s.,;:!?]|$)"
LEXICON = {k: f"(?i){_START}(?:{v}){_END}" for k, v in {"code": "def|class|return|import", "licence": "license|licensed|copyright", "greeting": "hello|hallo|hola|bonjour", "frequent": "the|und|que|les"}.items()}
WEIGHTED = {"legal": ("(?i)license", "(?i)version", "(?i)public"), "articles": tuple(f"(?i){_START}{w}{_END}" for w in ("the", "der", "la"))}


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents""")
def norm_text_eval(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.evaluation(F.col("text")).alias("t"))


@query("""SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+', ' ', 'g')) AS t FROM conversations""")
def norm_text_cmp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", N.comparison(F.col("text")).alias("t"))


_LETTERS = "len(regexp_extract_all(text, '[A-Za-z]'))"
_ARABIC = "len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]'))"


@query(f"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unknown' WHEN a + e = 0 THEN 'mixed' WHEN a / (a + e) >= 0.7 THEN 'ar' WHEN e / (a + e) >= 0.7 THEN 'en' ELSE 'mixed' END AS script,
CASE WHEN a + e = 0 THEN 0.0::DOUBLE ELSE round_even(greatest(a, e)::DOUBLE / (a + e), 4) END AS confidence FROM (SELECT doc_id, text, {_ARABIC} AS a, {_LETTERS} AS e FROM documents)""")
def lang_ratio(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", D.language(F.col("text")).alias("l"))
    return got.select("doc_id", F.col("l.lang").alias("script"), "l.confidence")


@query(f"""SELECT doc_id, CASE WHEN a + e = 0 THEN 'ltr' WHEN a / (a + e) > 0.7 THEN 'rtl' WHEN e / (a + e) > 0.7 THEN 'ltr' ELSE 'mixed' END AS direction,
CASE WHEN a + e = 0 THEN false ELSE a / (a + e) > 0.3 END AS is_rtl FROM (SELECT doc_id, {_ARABIC} AS a, {_LETTERS} AS e FROM documents)""")
def text_direction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.direction(F.col("text")).alias("direction"), D.is_rtl(F.col("text")).alias("is_rtl"))


@query("""SELECT doc_id, length(text) AS char_count, len(w) AS word_count, round(coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 0), 6) AS avg_word,
round(len(regexp_extract_all(text, '[0-9]'))::DOUBLE / greatest(length(text), 1), 6) AS digit_ratio, round(len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / greatest(length(text), 1), 6) AS latin_ratio,
round(len(list_distinct(w))::DOUBLE / greatest(len(w), 1), 6) AS unique_ratio FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.functions.similarity import text_features as features

    return features(table(spark, d, "documents"), "text").select("doc_id", "char_count", "word_count", "avg_word", "digit_ratio", "latin_ratio", "unique_ratio")


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</?p>', chr(10), 'g'), '(?i)<li>', chr(10) || '- ', 'g'), '(?i)</li>', '', 'g'), '<[^>]+>', '', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS t FROM pages""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", N.html_text(F.col("html")).alias("t"))


_PII_SQL = {n: p.replace("'", "''") for n, _, p in D.PII}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::INT AS {n.lower()}" for n, p in _PII_SQL.items()) + " FROM documents")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *D.pii_counts(F.col("text")))


def _nested(first: str) -> str:
    out = first
    for p in _PII_SQL.values():
        out = f"regexp_replace({out}, '{p}', '[REDACTED]', 'g')"
    return out


@query(f"SELECT doc_id, {_nested('text')} AS t FROM documents")
def anonymize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.anonymised(F.col("text")).alias("t"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'''regexp_matches(text, '{_PII_SQL[n]}')''' for n, l, _ in D.PII if l == level)} THEN '{level}'" for level in reversed(D.LEVELS[1:])) + " ELSE 'none' END AS risk FROM documents")
def doc_risk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.risk(F.col("text")).alias("risk"))


@query("SELECT doc_id, n::INT AS line_no, kind, level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) JOIN (VALUES " + ", ".join(f"('{n}', '{l}', '{_PII_SQL[n]}')" for n, l, _ in D.PII) + ") p(kind, level, re) ON regexp_matches(line, re)")
def secret_lines(spark: SparkSession, d: str) -> DataFrame:
    return D.secret_lines(table(spark, d, "documents"), "text", "doc_id")


def _hits(p: str) -> str:
    return f"len(regexp_extract_all(text, '{p}'))"


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"{_hits(p)} AS {k}" for k, p in LEXICON.items()) + " FROM documents), t AS (SELECT *, " + " + ".join(LEXICON) + " AS total, greatest(" + ", ".join(LEXICON) + ") AS top FROM h) SELECT doc_id, CASE WHEN total = 0 OR top / total < 0.15 THEN 'general' " + " ".join(f"WHEN {k} = top THEN '{k}'" for k in LEXICON) + " END AS category, CASE WHEN total = 0 THEN 0.3::DOUBLE ELSE round(top::DOUBLE / total, 6) END AS confidence FROM t")
def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", D.keyword_class(F.col("text"), LEXICON).alias("c"))
    return got.select("doc_id", "c.category", "c.confidence")


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"(3 * {_hits(a)} + 2 * {_hits(b)} + {_hits(c)})::INT AS {k}" for k, (a, b, c) in WEIGHTED.items()) + " FROM documents) SELECT doc_id, CASE WHEN greatest(" + ", ".join(WEIGHTED) + ") = 0 THEN 'general' " + " ".join(f"WHEN {k} = greatest({', '.join(WEIGHTED)}) THEN '{k}'" for k in WEIGHTED) + " END AS category, greatest(" + ", ".join(WEIGHTED) + ") AS score, round(CASE WHEN " + " + ".join(WEIGHTED) + " = 0 THEN 0 ELSE greatest(" + ", ".join(WEIGHTED) + ")::DOUBLE / (" + " + ".join(WEIGHTED) + ") END, 6) AS share FROM h")
def weighted_classify(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", D.weighted_class(F.col("text"), WEIGHTED).alias("c"))
    return got.select("doc_id", "c.category", "c.score", "c.share")


@query("WITH s AS (SELECT doc_id, trim(unnest(string_split(text, chr(10) || chr(10)))) AS text FROM documents), k AS (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in LEXICON.items()) + " ELSE 'general' END AS category FROM s WHERE length(text) > 20) SELECT doc_id, category, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, category) AS r FROM (SELECT doc_id, category, count(*) AS n FROM k GROUP BY doc_id, category)) WHERE r = 1")
def section_vote(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.aggregates import majority_vote

    parts = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.transform(F.split("text", "\n\n"), F.trim), lambda s: F.char_length(s) > 20)).alias("s"))
    kind = F.lit("general")
    for name, p in reversed(LEXICON.items()):
        kind = F.when(F.col("s").rlike(p), name).otherwise(kind)
    return majority_vote(parts.select("doc_id", kind.alias("category")), "doc_id", "category").select("doc_id", F.col("winner").alias("category"), F.col("votes").alias("n"))


@query("""SELECT doc_id, unnest(range(0, greatest(length(text) - 128, 1), 384))::INT AS start, substr(text, unnest(range(0, greatest(length(text) - 128, 1), 384)) + 1, 512) AS chunk FROM documents WHERE length(text) > 0""")
def chunking(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", F.explode(N.chunks(F.col("text"))).alias("c"))
    return got.select("doc_id", "c.start", F.col("c.text").alias("chunk"))


@query("""SELECT doc_id, string_agg(CASE WHEN regexp_matches(w, '[0-9]') AND regexp_matches(translate(w, 'OoIl|ZSGTB', '0011125678'), '^[0-9]+$') THEN translate(w, 'OoIl|ZSGTB', '0011125678') ELSE w END, ' ' ORDER BY i) AS t
FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS i FROM documents) GROUP BY doc_id""")
def digit_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.size(N.words(F.col("text"))) > 0).select("doc_id", N.repaired_digits(F.col("text")).alias("t"))


@query("""WITH m AS (SELECT w, min(w) || '_x' AS to_w FROM (SELECT lower(unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS w FROM benchmark) GROUP BY w HAVING count(*) >= 3),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))
SELECT doc_id, string_agg(coalesce(to_w, t.w), ' ' ORDER BY i) AS t FROM t LEFT JOIN m ON m.w = lower(t.w) GROUP BY doc_id""")
def dictionary_apply(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.correct import apply_dictionary

    fixes = table(spark, d, "benchmark").select(F.explode(N.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("word", F.concat("word", F.lit("_x")).alias("correction"))
    return apply_dictionary(table(spark, d, "documents"), fixes, "doc_id", "text").select("doc_id", F.col("corrected").alias("t"))


@query("""SELECT conv_id, sha256(string_agg(role || ':' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2})?(\\.\\d+)?(Z|[+-]\\d{2}:?\\d{2})?', '<ts>', 'g'), '\\d{4}-\\d{2}-\\d{2}', '<date>', 'g'),
'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'), '(/[A-Za-z0-9_.-]+){2,}', '<cwd>', 'g'), '\\b[0-9a-f]{7,40}\\b', '<gitsha>', 'g'), '\\s+', ' ', 'g')), '|' ORDER BY turn)) AS fingerprint, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", N.fingerprint_text(F.col("text"))).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x.t)
    return rows.groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("turns"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '[,;:!?][A-Za-z]'))::INT AS missing_space, len(regexp_extract_all(text, '\\s[.,;:!?]'))::INT AS space_before, text LIKE '%aaa%' AS triple FROM conversations""")
def grammar_check(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "conversations").select("conv_id", "turn", N.grammar(F.col("text")).alias("g"), F.col("text").contains("aaa").alias("triple"))
    return got.select("conv_id", "turn", "g.missing_space", "g.space_before", "triple")


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS value FROM documents) SELECT doc_id, value, count(*) AS n FROM m GROUP BY doc_id, value""")
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    got = D.spans(docs, "text", [("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")], ["doc_id", "text"])
    right = got.where(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value"))
    return right.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, '{"resourceType":"Bundle","type":"document","entry":[{"resource":{"resourceType":"Composition","title":"document ' || doc_id || '","section":[{' || coalesce('"text":' || to_json(text)::VARCHAR, '') || '}]}}]}' AS bundle FROM documents""")
def fhir_bundle(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.export import fhir

    docs = table(spark, d, "documents")
    return docs.select("doc_id", fhir(F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.col("text")).alias("bundle"))


@query("""SELECT doc_id, 'MSH|^~\\&|LEXFORGE|||||ORU^R01|' || doc_id || '|P|2.5' || chr(13) || 'PID|1||' || doc_id || chr(13) || 'OBR|1|||' || source || chr(13) || 'NTE|1||' || substr(replace(text, chr(10), ' '), 1, 500) AS message FROM documents""")
def hl7_message(spark: SparkSession, d: str) -> DataFrame:
    from lexforge.operators.export import hl7

    docs = table(spark, d, "documents")
    return docs.select("doc_id", hl7(F.col("doc_id").cast("string"), F.col("source"), F.col("text"), F.array().cast("array<struct<code:string,value:string>>")).alias("message"))
