"""Review queues, correction look-up, provider choice, line fusion, dedup safety, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.normalize import words
from lexforge.functions.similarity import jaccard


def review_queue(df: DataFrame, mode: str, limit: int, key: str) -> DataFrame:
    """flagged: flagged rows; new: oldest first; low_conf: least confident first; else by score."""
    order = {"flagged": [F.desc("score")], "new": [F.desc("days_since_seen")], "low_conf": [F.asc("confidence")]}.get(mode, [F.desc("score")])
    rows = df.where("flagged") if mode == "flagged" else df
    return rows.orderBy(*order, key).limit(limit)


def match_corrections(texts: DataFrame, corrections: DataFrame, text: str, least: float = 0.8) -> DataFrame:
    """text, corrected, similarity, match: the exact correction at 1.0, else all whose character sets
    are alike by more than least.

    Only distinct character sets meet, and only where they share one of the rarest characters that a
    set alike enough cannot do without, so neither texts nor corrections are paired off.
    """
    exact = texts.join(corrections.select(F.col("original").alias(text), "corrected"), text).select(text, "corrected", F.lit(1.0).alias("similarity"), F.lit("exact").alias("match"))
    letters = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(c, ""))), "")
    rest = texts.join(exact.select(text), text, "left_anti").withColumn("x", letters(F.col(text)))
    fixes = corrections.select("original", "corrected", letters(F.col("original")).alias("y"))
    each = lambda df, c: df.select(c).distinct().select(c, F.char_length(c).alias("n"), F.explode(F.split(c, "")).alias("ch"))
    a, b = each(rest, "x"), each(fixes, "y")
    often = a.select("ch").unionAll(b.select("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("df"))

    def rare(df: DataFrame, c: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(c).orderBy("df", "ch"))
        return df.join(often, "ch").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(c, "ch")

    pairs = rare(a, "x").join(rare(b, "y"), "ch").select("x", "y").distinct()
    pairs = pairs.withColumn("similarity", jaccard(F.split("x", ""), F.split("y", ""))).where(F.col("similarity") > least)
    fuzzy = rest.join(pairs, "x").join(fixes, "y").select(text, "corrected", "similarity", F.lit("fuzzy").alias("match"))
    return exact.unionByName(fuzzy)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased text, padded like pg_trgm's words."""
    padded = F.transform(words(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(padded, cut)))


def trigram_search(queries: DataFrame, base: DataFrame, q: str, term: str, least: float = 0.3) -> DataFrame:
    """q, term, similarity: shared trigrams over all trigrams, through an inverted join."""
    a = queries.select(q).distinct().select(q, trigrams(F.col(q)).alias("x"))
    b = base.select(term).distinct().select(term, trigrams(F.col(term)).alias("y"))
    left = a.select(q, F.size("x").alias("n"), F.explode("x").alias("g"))
    right = b.select(term, F.size("y").alias("m"), F.explode("y").alias("g"))
    shared = left.join(right, "g").groupBy(q, term, "n", "m").agg(F.count(F.lit(1)).alias("s"))
    return shared.select(q, term, (F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).alias("similarity")).where(F.col("similarity") >= least)


def pattern_lookup(patterns: DataFrame, image_hash: str, language: str, writer: str) -> DataFrame:
    """Patterns of a hash that were used often enough to be trusted."""
    trusted = (F.col("usage") >= 2) & ((F.col("usage") >= 3) | (F.col("corrections") >= 1))
    return patterns.where((F.col("image_hash") == image_hash) & (F.col("language") == language) & (F.col("writer_id") == writer) & trusted)


def fallback_model(models: DataFrame, tier: int, provider: str) -> DataFrame:
    """The best free model of a lower tier, of the same provider if it has one, then the cheapest."""
    rows = models.where((F.col("tier") < tier) & ~F.col("limited"))
    return rows.orderBy((F.col("provider") == provider).desc(), F.desc("tier"), F.asc("cost"), "name").limit(1)


def next_account(accounts: DataFrame, strategy: str, turn: int = 0) -> DataFrame:
    """One account: by priority, least recently used, by weighted hash of the turn, or round robin."""
    free = accounts.where("active")
    if strategy == "priority":
        return free.orderBy(F.desc("priority"), "id").limit(1)
    if strategy == "lru":
        return free.orderBy(F.asc_nulls_first("last_used"), "id").limit(1)
    if strategy == "weighted":
        u = (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1_000_003)) + 1) / 1_000_004
        return free.orderBy((-F.ln(u) / F.greatest("weight", F.lit(1e-9))).asc(), "id").limit(1)
    n = free.count()
    return free.orderBy("id").offset(turn % n).limit(1) if n else free.limit(0)


def fused_lines(df: DataFrame, key: str, strategy: str, weights: dict[str, float]) -> DataFrame:
    """key, text, confidence of each line read by several engines (engine, text, confidence).

    highest_confidence weighs by engine; weighted_average keeps the best text with the weighted mean;
    voting takes the most frequent text (three readings or more, else the best); longest_text.
    """
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("engine")), F.lit(0.8))
    rows = df.withColumn("w", w)
    best = F.max_by(F.struct("text", "confidence"), F.struct(F.col("confidence") * F.col("w"), "engine", "text"))
    if strategy == "longest_text":
        best = F.max_by(F.struct("text", "confidence"), F.struct(F.char_length("text"), "confidence", "engine", "text"))
    if strategy == "voting":
        counted = rows.groupBy(key, "text").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
        total = counted.withColumn("all", F.sum("n").over(Window.partitionBy(key)))
        rank = F.when(F.col("all") >= 3, F.col("n")).otherwise(F.lit(0))
        return total.groupBy(key).agg(F.max_by(F.struct("text", "confidence"), F.struct(rank, "confidence", "text")).alias("b")).select(key, "b.text", "b.confidence")
    got = rows.groupBy(key).agg(best.alias("b"), (F.sum(F.col("confidence") * F.col("w")) / F.sum("w")).alias("mean"))
    return got.select(key, "b.text", (F.col("mean") if strategy == "weighted_average" else F.col("b.confidence")).alias("confidence"))


def merged_pages(pages: DataFrame, doc: str, page: str, weights: dict[str, float]) -> DataFrame:
    """doc, page, text, confidence, engines: pages of a document read by several engines, joined by
    their ordinal; a page that some engine lacks is taken from the others."""
    best = fused_lines(pages.withColumn("__k", F.struct(doc, page)), "__k", "highest_confidence", weights)
    engines = pages.groupBy(doc, page).agg(F.array_join(F.array_sort(F.collect_set("engine")), " + ").alias("engines"))
    return best.select(F.col(f"__k.{doc}").alias(doc), F.col(f"__k.{page}").alias(page), "text", "confidence").join(engines, [doc, page])


def classification_vote(sections: DataFrame, doc: str, category: str, confidence: str) -> DataFrame:
    """doc, category, confidence, share: the category of most summed confidence over a document's sections, ties by name; no share of a sum of zero."""
    sums = sections.groupBy(doc, category).agg(F.sum(confidence).alias("s"))
    got = sums.groupBy(doc).agg(F.min_by(F.struct(category, "s"), F.struct(-F.round("s", 9), category)).alias("b"), F.sum("s").alias("all"))
    return got.select(doc, f"b.{category}", F.col("b.s").alias("confidence"), F.try_divide("b.s", "all").alias("share"))


def dedup_safety(cases: DataFrame, key: str) -> DataFrame:
    """key, recall, preserved: tokens of the input that the output still has, and the share of
    protected pairs (array<struct<a,b>>) whose two texts are both still there."""
    have = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda t: words(F.lower(t)))))
    recall = F.when(F.size(have(F.col("input"))) > 0, F.size(F.array_intersect(have(F.col("input")), have(F.col("output")))) / F.size(have(F.col("input")))).otherwise(1.0)
    safe = F.filter("protected", lambda p: F.array_contains("output", p.a) & F.array_contains("output", p.b))
    return cases.select(key, recall.alias("recall"), F.when(F.size("protected") > 0, F.size(safe) / F.size("protected")).otherwise(1.0).alias("preserved"))


def bilingual_pairs(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, english, arabic of the lines that hold both."""
    en, ar = (F.array_join(F.regexp_extract_all(text, F.lit(p), F.lit(0)), " ") for p in ("[A-Za-z]+", "[؀-ۿ]+"))
    return lines.select(key, en.alias("english"), ar.alias("arabic")).where("english <> '' and arabic <> ''")


def readable(text: Column, confidence: Column, shortest: int = 3, least: float = 0.5) -> Column:
    """The text, or nothing where it is too short or too uncertain."""
    return F.when((F.char_length(F.trim(text)) >= shortest) & (confidence >= least), text).otherwise("")


# Arabic letters that differ by their dots alone.
DOTTED = ["بتثنيئ", "جحخ", "دذ", "رز", "سش", "صض", "طظ", "عغ", "فق"]


def dot_variants(word: Column) -> Column:
    """All words that differ from word by the dots of one letter, word itself included."""
    letters = F.split(word, "")
    group = F.create_map(*[F.lit(x) for g in DOTTED for ch in g for x in (ch, g)])
    at = F.sequence(F.lit(1), F.char_length(word))
    swaps = lambda i: F.transform(F.split(F.coalesce(group[F.substring(word, i, F.lit(1))], F.substring(word, i, F.lit(1))), ""), lambda ch: F.overlay(word, ch, i, F.lit(1)))
    return F.when(F.char_length(word) > 0, F.array_distinct(F.flatten(F.transform(at, swaps)))).otherwise(letters)


def recovered(tokens: DataFrame, vocabulary: DataFrame, token: str) -> DataFrame:
    """token, word: the most frequent vocabulary word among a token's dot variants, else the token."""
    tried = tokens.select(token).distinct().select(token, F.explode(dot_variants(F.col(token))).alias("word"))
    hit = tried.join(vocabulary.select("word", "frequency"), "word")
    best = hit.groupBy(token).agg(F.max_by("word", F.struct((F.col("word") == F.col(token)).alias("same"), "frequency", "word")).alias("word"))
    return tokens.select(token).distinct().join(best, token, "left").select(token, F.coalesce("word", token).alias("word"))
