"""Spelling queries: candidates, close matches, suggestions and corrected texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import spelling as S
from lexforge.plans.base import query
from lexforge.session import cut, table

PROTECTED = ["Apache", "license", "token", "CT", "MRI"]
LEAST_COUNT = 40

_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')"
#: lower-case words of letters only, as often as a dictionary wants them
_VOCAB = f"(SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) WHERE regexp_matches(w, '^\\p{{L}}+$') GROUP BY 1 HAVING count(*) >= {LEAST_COUNT})"
#: DuckDB's distances count bytes: each accented letter of the tables becomes one byte that lower-case words do not hold
_BYTES = lambda w: f"translate({w}, 'éßóçäèñöüêíáúàâîôûëïœæåøãõìòùÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')"
_KEPT = ", ".join(f"'{w}'" for w in [*S.KEYWORDS, *PROTECTED])
_ALONE = f"""(regexp_matches(w, '^[^a-zA-Z؀-ۿ]+$') OR w IN ({_KEPT}) OR lower(w) IN ({_KEPT}) OR regexp_matches(w, '[_-]') OR regexp_matches(w, '^[a-z]+[A-Z]') OR regexp_matches(w, '^[A-Z][a-z]+[A-Z]')
OR regexp_matches(w, '\\.[\\p{{L}}\\p{{N}}_]{{1,4}}$') OR length(w) <= 1 OR NOT (2 * length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) > length(w) OR 2 * length(regexp_replace(w, '[^؀-ۿ]', '', 'g')) > length(w)))"""
_NEAR = lambda asked: f"""SELECT * FROM (SELECT a.word, v.word AS candidate, v.n, damerau_levenshtein({_BYTES('a.word')}, {_BYTES('v.word')}) AS distance
FROM {asked} a JOIN vocab v ON abs(length(a.word) - length(v.word)) <= 2) WHERE distance <= 2"""  # noqa: E731


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return cut(S.word_counts(table(spark, d, "documents"), "text").where(F.col("count") >= LEAST_COUNT))


@query(f"""WITH vocab AS {_VOCAB}, asked AS (SELECT DISTINCT lower(unnest(string_split_regex(p_name, '[^A-Za-z]+'))) AS word FROM part UNION SELECT DISTINCT lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) FROM benchmark)
SELECT word, candidate, CAST(distance AS INTEGER) AS distance FROM ({_NEAR("(SELECT * FROM asked WHERE word <> '')")})""")
def spelling_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names and benchmark texts beside every dictionary word of the documents within two edits."""
    words = lambda t, c: table(spark, d, t).select(F.explode(F.split(F.lower(c), "[^A-Za-z]+")).alias("word"))
    return S.edit_candidates(words("part", "p_name").unionAll(words("benchmark", "text")), _vocabulary(spark, d))


_NAMES = "(SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS word FROM part)"


@query(f"""WITH q AS (SELECT DISTINCT replace(word, 'e', 'a') AS query FROM {_NAMES}), s AS (SELECT query, word, 1 - levenshtein(query, word)::DOUBLE / greatest(length(query), length(word)) AS s FROM q, {_NAMES} v)
SELECT query, word, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, word) AS r FROM s WHERE s >= 0.45) WHERE r <= 5""")
def close_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    asked = words.select(F.replace("word", F.lit("e"), F.lit("a")).alias("word")).distinct()
    return S.close_words(asked, words).withColumn("similarity", F.round("similarity", 6))


@query()
def word_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Ranked suggestions for every word of the benchmark texts: votes and fixes of the documents, dictionary, edits."""
    asked = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(S.TOKEN), F.lit(0))).alias("word"))
    fixes = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("correction")).select(F.replace("correction", F.lit("e"), F.lit("a")).alias("word"), "correction").where("word <> correction")
    return S.suggestions(asked, _vocabulary(spark, d), fixes, _votes(spark, d), PROTECTED)


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """A reviewer who takes the sign off the last word of each text."""
    end = F.substring_index(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), " ", -1)
    last = F.regexp_extract(end, r"([\p{L}]+[.,;!?])$", 1)
    return table(spark, d, "documents").select(last.alias("original"), F.regexp_replace(last, "[.,;!?]$", "").alias("corrected")).where("original <> ''")


@query(f"""WITH vocab AS {_VOCAB}, docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+([ \\t\\n\\x0B\\f\\r]*)', 1) AS gaps FROM documents WHERE text IS NOT NULL),
tok AS (SELECT row, unnest(ws) AS w, unnest(gaps) AS gap, generate_subscripts(ws, 1) AS i FROM docs),
votes AS (SELECT lower(o) AS k, regexp_replace(o, '[.,;!?]$', '') AS c, count(*) AS n FROM (SELECT regexp_extract(text, '([\\p{{L}}]+[.,;!?])[ \\t\\n\\x0B\\f\\r]*$', 1) AS o FROM documents) WHERE o <> '' GROUP BY 1, 2),
learned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, c) AS r FROM votes) WHERE r = 1 AND n >= 2),
open AS (SELECT DISTINCT w, lower(w) AS k FROM tok WHERE NOT {_ALONE}),
state AS (SELECT w, open.k, learned.c AS voted, vocab.word AS known FROM open LEFT JOIN learned ON learned.k = open.k LEFT JOIN vocab ON vocab.word = open.k),
near AS ({_NEAR("(SELECT DISTINCT k AS word FROM state WHERE voted IS NULL AND known IS NULL AND length(w) > 2)")}),
best AS (SELECT word, candidate FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, candidate) AS r FROM near) WHERE r = 1),
fixed AS (SELECT w, coalesce(voted, candidate) AS c FROM state LEFT JOIN best ON best.word = state.k AND voted IS NULL AND known IS NULL AND length(w) > 2 WHERE coalesce(voted, candidate) <> w),
new AS (SELECT row, i, tok.w, gap, coalesce(c, tok.w) AS now FROM tok LEFT JOIN fixed ON fixed.w = tok.w),
placed AS (SELECT *, coalesce(sum(length(now) + length(gap)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM new),
made AS (SELECT row, string_agg(now || gap, '' ORDER BY i) AS corrected, coalesce(string_agg(w || '>' || now || '>' || place, ' ' ORDER BY i) FILTER (w <> now), '') AS changes, count(*) FILTER (w <> now) AS n_changes FROM placed GROUP BY row)
SELECT doc_id, coalesce(corrected, '') AS corrected, coalesce(changes, '') AS changes, CAST(coalesce(n_changes, 0) AS BIGINT) AS n_changes FROM docs LEFT JOIN made USING (row)""")
def spell_corrected(spark: SparkSession, d: str) -> DataFrame:
    """All documents, spelled by their own frequent words; reviewers' votes go before candidates."""
    got = S.corrected_texts(table(spark, d, "documents"), "doc_id", "text", _vocabulary(spark, d), _votes(spark, d), PROTECTED)
    return got.withColumn("changes", F.array_join(F.transform("changes", lambda c: F.concat_ws(">", c.original, c.corrected, c.position)), " "))
