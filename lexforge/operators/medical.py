"""Entities, relations, categories and terminology of medical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.detect import each, span_list, spans
from lexforge.functions.normalize import bound

#: Entity patterns (English and Arabic); the order is their priority.
ENTITIES = [
    ("DIAGNOSIS", r"(?i)\b(?:diagnosis|diagnosed with)[:\s]+[a-z][a-z ]{2,40}|تشخيص[:\s]+[؀-ۿ]+"),
    ("MEDICATION", r"(?i)\b[a-z]{4,}(?:cillin|mycin|statin|pril|olol|azole|formin)\b|\b(?:aspirin|warfarin|ibuprofen|paracetamol)\b|دواء\s+[؀-ۿ]+"),
    ("PROCEDURE", r"(?i)\b(?:surgery|biopsy|x-ray|mri|ct scan|endoscopy|replacement)\b|عملية\s+[؀-ۿ]+"),
    ("ANATOMY", r"(?i)\b(?:knee|hip|femur|tibia|spine|wrist|heart|lung|liver)\b|عظم|ركبة|قلب"),
    ("DATE", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("VALUE", r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|ml|mmhg|bpm|kg|cm)\b"),
]
# Relation patterns, English and Arabic; subject and object, or the subject alone.
RELATIONS = [
    ("DIAGNOSED_WITH", r"(?is)patient\s+(?:has|is diagnosed with|was diagnosed with|suffers from)\s+(.+?)()(?:,|;|\.|\n|$)"),
    ("PRESCRIBED_FOR", r"(?is)(?:prescribed|take|administer(?:ed)?|given)\s+(.+?)\s+(?:for|to treat)\s+(.+?)(?:,|;|\.|\n|$)"),
    ("PERFORMED_ON", r"(?is)(?:perform(?:ed)?|underwent)\s+(.+?)\s+(?:on|of)\s+(.+?)(?:,|;|\.|\n|$)"),
    ("VALUE_OF", r"(?is)(?:normal|abnormal|elevated|low|high)\s+(.+?)\s+(?:in|of)\s+(.+?)(?:,|;|\.|\n|$)"),
    ("DIAGNOSED_WITH", r"(?is)(?:المريض|المريضة)\s+(?:مصاب|مصابة)\s+بـ?\s+(.+?)()(?:،|؛|\.|\n|$)"),
    ("PRESCRIBED_FOR", r"(?is)(?:وصف|يأخذ|تناول)\s+(.+?)\s+(?:لعلاج|لـ)\s+(.+?)(?:،|؛|\.|\n|$)"),
    ("PERFORMED_ON", r"(?is)(?:إجراء|تم|أجري)\s+(.+?)\s+(?:على|في)\s+(.+?)(?:،|؛|\.|\n|$)"),
    ("VALUE_OF", r"(?is)(?:طبيعي|غير طبيعي|مرتفع|منخفض)\s+(.+?)\s+(?:في|من)\s+(.+?)(?:،|؛|\.|\n|$)"),
]
CATEGORIES = {
    "anatomy": r"(?i)\b(?:bone|joint|muscle|knee|hip|spine)\b|عظم|مفصل", "fractures": r"(?i)\bfractur\w*|كسر", "surgery": r"(?i)\b(?:surg\w*|operation)\b|جراح", "drugs": r"(?i)\b(?:drug|dose|tablet|mg)\b|دواء",
    "diagnosis": r"(?i)\b(?:diagnos\w*|symptom)\b|تشخيص", "imaging": r"(?i)\b(?:x-ray|mri|ct|scan)\b|أشعة", "therapy": r"(?i)\b(?:therapy|treatment|rehab\w*)\b|علاج",
}
PERSON = r"(?:Dr|Prof|Mr|Mrs|Ms)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
ORGANISATION = r"[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Hospital|University|Clinic|Institute|Company)"
PLACE = r"\b(?:in|at|from)\s+([A-Z][a-z]{2,})"
TYPOS = {"hipertension": "hypertension", "diabetis": "diabetes", "pnemonia": "pneumonia", "arthritus": "arthritis", "anemea": "anemia"}


def entity_list(text: Column) -> Column:
    """array<struct<p,start,end,kind,value>> of a text's entities, without those that overlap one of higher priority."""
    rank = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(ENTITIES) for x in (k, i)])
    ranked = F.array_sort(F.transform(span_list(text, ENTITIES), lambda s: F.struct(F.element_at(rank, s.kind).alias("p"), s.start, s.end, s.kind, s.value)))
    free = lambda acc, s: ~F.exists(acc, lambda t: (t.start < s.end) & (s.start < t.end))
    return bound(ranked, lambda r: F.aggregate(r, F.slice(r, 1, 0), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc)))


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, end, value of the entities, without those that overlap one of higher priority in the same text."""
    rows = each(df.select(key, F.explode_outer(entity_list(F.col(text))).alias("x")))
    return rows.select(key, "x.kind", "x.start", "x.end", "x.value")


def triple_list(text: Column) -> Column:
    """array<struct<subject,relation,object>> of a text; the object is empty where the pattern names none."""

    def triples(name: str, p: str) -> Column:
        return bound(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda subjects: with_objects(name, p, subjects))

    def with_objects(name: str, p: str, subjects: Column) -> Column:
        both = F.zip_with(subjects, F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda s, o: F.struct(F.lower(F.trim(s)).alias("subject"), F.lit(name).alias("relation"), F.lower(F.trim(o)).alias("object")))
        return F.when(F.size(subjects) > 0, both).otherwise(F.array().cast("array<struct<subject:string,relation:string,object:string>>"))

    return F.concat(*[triples(name, p) for name, p in RELATIONS])


def relations(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, subject, relation, object triples; the object is empty where the pattern names none."""
    return each(df.select(key, F.explode_outer(triple_list(F.col(text))).alias("x"))).select(key, "x.subject", "x.relation", "x.object")


def grounded_relations(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, subject, relation, object and the entity kinds of subject and object in the same text, null where none has that text; nothing is shuffled."""
    lists = df.select(key, triple_list(F.col(text)).alias("__t"), entity_list(F.col(text)).alias("__e"))
    named = each(lists.select(key, "__e", F.explode_outer("__t").alias("x")))
    kind = lambda c: F.array_min(F.transform(F.filter("__e", lambda e: F.lower(F.trim(e.value)) == F.col(c)), lambda e: e.kind))
    return named.select(key, "x.subject", "x.relation", "x.object", kind("x.subject").alias("subject_kind"), kind("x.object").alias("object_kind"))


def grounded(triples: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Triples with the entity kinds of subject and object, null where none has that text."""
    kinds = found.select(key, F.lower(F.trim("value")).alias("value"), "kind").groupBy(key, "value").agg(F.min("kind").alias("kind"))
    out = triples.join(kinds.withColumnsRenamed({"value": "subject", "kind": "subject_kind"}), [key, "subject"], "left")
    return out.join(kinds.withColumnsRenamed({"value": "object", "kind": "object_kind"}), [key, "object"], "left")


def names(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, end, value of persons, organisations and dates by prefix and suffix words."""
    return spans(df.select(key, text), text, [("PERSON", PERSON), ("ORGANIZATION", ORGANISATION), ("DATE", ENTITIES[4][1])], [key])


def category_hits(c: Column) -> Column:
    """How often the pattern of each category is found."""
    return F.array(*[F.regexp_count(c, F.lit(p)) for p in CATEGORIES.values()])


def category_of(hits: Column) -> Column:
    """Category of most hits, ties to the first; general without hits."""
    most = F.array_max(hits)
    return F.when(most > 0, F.element_at(F.array(*map(F.lit, CATEGORIES)), F.array_position(hits, most).cast("int"))).otherwise("general")


def category(c: Column) -> Column:
    """Category of most pattern hits, ties to the first; short texts and no hits are general."""
    return bound(category_hits(c), category_of)


def confidence_of(source: Column, hits: Column) -> Column:
    """0.5, more for short terms, a tenth per pattern hit up to three, 1 at most."""
    short = F.when(F.char_length(source) < 30, 0.2).when(F.char_length(source) < 60, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + short + F.least(0.1 * F.aggregate(hits, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))), F.lit(0.3)))


def term_confidence(source: Column, target: Column) -> Column:
    """0.5, more for short terms, a tenth per pattern hit in both texts up to three, 1 at most."""
    return bound(category_hits(F.concat_ws(" ", source, target)), lambda hits: confidence_of(source, hits))


def classified(c: Column) -> Column:
    """struct<category,confidence> of a text by itself, from one count of the hits."""
    return bound(category_hits(c), lambda hits: F.struct(category_of(hits).alias("category"), confidence_of(c, hits).alias("confidence")))


def dictionary_entry(term: Column, definition: Column) -> Column:
    """struct<term_ar,term_en,category,kind>: scripts apart, a bracketed category first, then keywords."""
    ar = F.trim(F.array_join(F.regexp_extract_all(F.concat_ws(" ", term, definition), F.lit("[؀-ۿ]+"), F.lit(0)), " "))
    en = F.when(term.rlike("[A-Za-z]"), F.trim(F.regexp_replace(term, "[؀-ۿ]+", " ")))
    bracket = F.regexp_extract(definition, r"\[([A-Za-z ]+)\]", 1)
    return F.struct(F.nullif(ar, F.lit("")).alias("term_ar"), en.alias("term_en"), F.when(bracket != "", F.lower(bracket)).otherwise(category(F.concat_ws(" ", term, definition))).alias("category"), F.when(F.lower(definition).contains("correction"), "correction").otherwise("term").alias("kind"))


def misspellings(c: Column) -> Column:
    """Known misspellings that occur while the right word does not."""
    low = F.lower(c)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(w)) & ~F.contains(low, F.lit(r)), F.lit(w)) for w, r in TYPOS.items()]), lambda x: x.isNotNull())


def by_kind(found: DataFrame, key: str) -> DataFrame:
    """key, kind and the sorted distinct values."""
    return found.groupBy(key, "kind").agg(F.array_sort(F.collect_set("value")).alias("entries"))


def lead_summary(c: Column, longest: int = 200) -> Column:
    """The first sentences that fit, or the beginning: what a summary falls back to."""
    head = F.substring(c, F.lit(1), F.lit(longest))
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.char_length(c) <= longest, c).when(whole != "", whole).otherwise(head)
