"""Personal data: fixed shapes as seeds, and bootstrapped contextual patterns that find the rest.

Round by round: seed entities induce lexical patterns from the words around them; Spark scores the
graph of patterns and instances; patterns of high confidence name identifiers that no fixed shape
matches. Null text counts as empty and gives no spans; repeated rows give repeated results (and
count as often, as texts that quote each other do); other columns are not read unless they are to
be kept, whatever their names; ids of any type, null included, come back as they were. Spans of one
start are ordered by kind as listed; of several patterns at one identifier the first of
patterns_at decides; a pattern that scores alike for two kinds takes the later name.

Context is looked for within LEFT characters before and RIGHT after; a word that reaches beyond
makes no pattern. Every step over a text is linear in it. No text is shuffled: what leaves a task
are (pattern, instance) counts, summed before they are dealt out. Which patterns are counted or
looked up goes to the tasks as a filter of at most 2**FILTER_BITS bits, which lets through all that
are wanted and few others; a join by pattern then decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import map_batches, map_tasks, staged, text_of
from lexforge.llm.secrets import SPANS, digest_rows, merged

BASE = ("email", "ip", "card", "phone")
KINDS = {k: i for i, k in enumerate((*BASE, *(f"context_{k}" for k in BASE)))}

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[A-Za-z0-9._%+@/#-]+")
TELLING = re.compile(r"[0-9@]")
LEFT, RIGHT, FILTER_BITS = 80, 48, 27
REMEMBER = 200_000  # tokens
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = str.maketrans("123456789", "000000000")


@dataclass(frozen=True)
class Bootstrap:
    """Bounds of the induction. A pattern is accepted when it has enough distinct seeds and score."""

    rounds: int = 3
    least_seeds: int = 3
    accept: float = 0.6
    prior: float = 1.0
    most_broadcast: int = 100_000  # accepted patterns that go to the tasks as a table; more are joined


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each '@' in linear time."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed shapes; each kind is leftmost and non-overlapping within itself."""
    found = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = m.group().split(".")
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in parts):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def word(token: str) -> str:
    """A context word: lower case, digits alike, outer punctuation gone but for a closing label mark."""
    token = token.lower().translate(_DIGITS)
    return token.strip(".,;()[]{}<>\"'!?") or token


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around [start, end): two words before; one before and one after; a label."""
    low, high = max(0, start - LEFT), min(len(text), end + RIGHT)
    left, right = text[low:start].split(), text[end:high].split()
    if left and low and not text[low].isspace() and not text[low - 1].isspace():
        left = left[1:]
    if right and high < len(text) and not text[high - 1].isspace() and not text[high].isspace():
        right.pop()
    left, right = [word(t) for t in left[-2:]], [word(t) for t in right[:1]]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if left and left[-1][-1:] in ":=":
        out.append(f"{left[-1]} _")
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-shaped runs outside the base spans, found in one walk along both."""
    out, at, taken = [], 0, merged(base)
    for m in RUN.finditer(text):
        start, end = m.start(), m.end()
        if end - start < 5 or not TELLING.search(text, start, end):
            continue
        while text[end - 1] in ".-/%+#":
            end -= 1
        while text[start] in ".-/%":
            start += 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end - start >= 5 and (at == len(taken) or taken[at][0] >= end):
            out.append((start, end))
    return out


def edges(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, inst, kind, n): kind is the seed's, or empty for identifiers that are no seed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for value in frame["t"]:
            text = text_of(value)
            base = base_spans(text)
            spans = [*base, *((s, e, "") for s, e in candidates(text, base))]
            for s, e, kind in spans:
                inst = text[s:e].lower()
                for p in patterns_at(text, s, e):
                    seen[p, inst, kind] += 1
        return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["pattern", "inst", "kind", "n"])

    got = map_batches(df.select(df[text_col].alias("t")), run, "pattern string, inst string, kind string, n long")
    return got.groupBy("pattern", "inst", "kind").agg(F.sum("n").alias("n"))


def hashed(value: str) -> int:
    """Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(value, 42)


def bit_filter(words: DataFrame, column: Column, count: int) -> np.ndarray:
    """Bits of the hashes of column: 64 for each of count words, at most 2**FILTER_BITS (16 MB)."""
    bits = min(FILTER_BITS, max(15, (64 * max(count, 1)).bit_length()))
    at = F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))
    cells = words.groupBy(F.floor(at / 32768).alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in cells.collect():  # at most 2**(FILTER_BITS - 15) rows of 4 kB
        out[r["cell"] * 4096 : (r["cell"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def lets(bits: np.ndarray, value: str) -> bool:
    """Whether bit_filter may hold value; always if it does."""
    at = hashed(value) & (8 * len(bits) - 1)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def occurrences(df: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """(pattern, total): how often each pattern's words stand around any single token, in all texts."""
    count = patterns.count()
    shared = df.sparkSession.sparkContext.broadcast(  # two filters of bounded size
        (bit_filter(patterns, F.col("pattern"), count), bit_filter(patterns, F.substring_index("pattern", " ", 1), count))
    )

    def start():
        norm: dict[str, tuple[str, bool]] = {}  # of a task's tokens, so that each is looked at about once

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            wanted, lefts = shared.value
            seen: Counter = Counter()
            for value in frame["t"]:
                toks = text_of(value).split()
                for t in set(toks).difference(norm):
                    w = word(t)
                    norm[t] = w, lets(lefts, w)
                toks = [norm[t] for t in toks]
                for j in [j for j, t in enumerate(toks) if t[1]]:
                    a = toks[j][0]
                    seen[f"{a} _"] += 1
                    if j + 1 < len(toks):
                        seen[f"{a} {toks[j + 1][0]} _"] += 1
                    if j + 2 < len(toks):
                        seen[f"{a} _ {toks[j + 2][0]}"] += 1
                if len(norm) > REMEMBER:
                    norm.clear()
            found = [(p, n) for p, n in seen.items() if lets(wanted, p)]
            return pd.DataFrame(found, columns=["pattern", "n"])

        return run

    got = map_tasks(df.select(df[text_col].alias("t")), start, "pattern string, n long")
    got = got.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi")
    return staged(got, "pii-totals")


def induce(df: DataFrame, text_col: str = "text", rule: Bootstrap | None = None) -> DataFrame:
    """(pattern, kind, score) of the accepted patterns.

    An instance scores 1 for its own kind if it is a seed, else the noisy-or of its patterns. A
    pattern scores the weight of its instances over all its occurrences plus a prior, so words that
    stand everywhere never qualify, however many seeds they have.
    """
    rule = rule or Bootstrap()
    graph = staged(edges(df, text_col), "pii-edges")
    support = (
        graph.where("kind <> ''")
        .groupBy("pattern", "kind")
        .agg(F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("weight"))
        .where(F.col("seeds") >= rule.least_seeds)
    )
    support = staged(support, "pii-support")
    totals = occurrences(df, support.select("pattern").distinct(), text_col)
    own = graph.groupBy("pattern").agg(F.sum("n").alias("own"))
    base = support.join(totals, "pattern", "left").join(own, "pattern")
    base = base.select("pattern", "kind", "seeds", "weight", "own", F.greatest(F.coalesce("total", F.lit(0)), "own").alias("total"))
    # instances can at most add their own occurrences, so the rest can never be accepted
    base = staged(base.where((F.col("own") >= rule.accept * F.col("total"))).drop("own"), "pii-base")
    scored = base.withColumn("score", F.col("weight") / (F.col("total") + rule.prior))
    others = graph.where("kind = ''").select("pattern", "inst", "n")
    for _ in range(rule.rounds - 1):
        touched = others.join(scored.select("pattern", "kind", "score"), "pattern")
        inst = touched.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
        gained = (
            touched.join(inst, ["inst", "kind"])
            .groupBy("pattern", "kind")
            .agg(F.sum(F.col("n") * F.col("belief")).alias("gain"))
        )
        scored = staged(
            base.join(gained, ["pattern", "kind"], "left").withColumn(
                "score", (F.col("weight") + F.coalesce("gain", F.lit(0.0))) / (F.col("total") + rule.prior)
            ).select("pattern", "kind", "seeds", "weight", "total", "score"),
            "pii-scores",
        )
    best = scored.where(F.col("score") >= rule.accept).groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    return staged(best, "pii-accepted")


def spans_of(text: str, kind_of) -> list[dict]:
    """Base spans and, where kind_of(text, start, end) names a kind, context spans of one text."""
    base = base_spans(text)
    spans = [(s, e, k, True) for s, e, k in base]
    if kind_of:
        for s, e in candidates(text, base):
            if kind := kind_of(text, s, e):
                spans.append((s, e, f"context_{kind}", False))
    spans.sort(key=lambda x: (x[0], KINDS[x[2]], x[1]))
    return [{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in spans]


def find(df: DataFrame, accepted: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Bootstrap | None = None) -> DataFrame:
    """id, spans array<struct<start,end,kind,base>> of every whole text."""
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("t"))
    got = _mapped(texts, accepted, rule or Bootstrap(), lambda text, spans: spans, f"spans {SPANS}", ["id"])
    return got.withColumnRenamed("id", id_col)


def _mapped(texts: DataFrame, accepted: DataFrame, rule: Bootstrap, make, schema: str, carry: list[str]) -> DataFrame:
    """The columns of carry and what make(text, spans) gives for column t."""
    name = schema.split()[0]
    count = accepted.count()
    if count <= rule.most_broadcast:
        shared = texts.sparkSession.sparkContext.broadcast({r["pattern"]: r["kind"] for r in accepted.select("pattern", "kind").collect()})

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            known = shared.value
            kind_of = (lambda text, s, e: next((known[p] for p in patterns_at(text, s, e) if p in known), None)) if known else None
            return pd.DataFrame({name: [make(t, spans_of(text_of(t), kind_of)) for t in frame["t"]]}, dtype=object)

        return map_batches(texts, run, schema, carry)

    # too many to hold: what a filter lets through of each text's patterns meets the accepted ones by a join
    rows = staged(texts.withColumn("row", F.monotonically_increasing_id()), "pii-texts")
    bits = texts.sparkSession.sparkContext.broadcast(bit_filter(accepted, F.col("pattern"), count))  # bounded

    def hits(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text in map(text_of, frame["t"]):
            found = [(s, i, p) for s, e in candidates(text, base_spans(text)) for i, p in enumerate(patterns_at(text, s, e)) if lets(bits.value, p)]
            out.append([{"start": s, "i": i, "pattern": p} for s, i, p in found])
        return pd.DataFrame({"hits": out})

    asked = map_batches(rows.select("row", "t"), hits, "hits array<struct<start:long,i:int,pattern:string>>", ["row"])
    asked = asked.select("row", F.explode("hits").alias("h")).select("row", "h.start", "h.i", "h.pattern")
    kinds = asked.join(accepted.select("pattern", "kind"), "pattern").groupBy("row", "start").agg(F.min_by("kind", "i").alias("kind"))
    kinds = kinds.groupBy("row").agg(F.collect_list(F.struct("start", "kind")).alias("kinds"))  # of one text

    def named(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, kinds in zip(frame["t"], frame["kinds"], strict=True):
            at = {k["start"]: k["kind"] for k in kinds} if kinds is not None else {}
            out.append(make(t, spans_of(text_of(t), (lambda text, s, e, at=at: at.get(s)) if at else None)))
        return pd.DataFrame({name: out}, dtype=object)

    return map_batches(rows.join(kinds, "row", "left").select(*carry, "t", "kinds"), named, schema, carry)


def redact_text(text: str, spans) -> str:
    """Text with each stretch of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for s, e, kind in sorted((int(x["start"]), int(x["end"]), x["kind"]) for x in spans):
        if s >= at:
            out += [text[at:s], f"[{kind.removeprefix('context_').upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: personal data of every whole text of documents, with the digest of the fixed shapes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_rows(find(docs, induce(docs)), "doc_id", BASE)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs with personal data replaced by the name of its kind, n_chars renewed.

    Every row stays, repeated ones too; null texts stay null, texts without finds as they were; of
    overlapping spans the first names the whole stretch.
    """
    others = [c for c in docs.columns if c != "text"]
    given = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(others)), docs["text"].alias("t"))
    replaced = lambda text, spans: redact_text(text, spans) if isinstance(text, str) else None
    got = _mapped(given, induce(docs), Bootstrap(), replaced, "redacted string", [f"k{i}" for i in range(len(others))])
    got = got.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(others)), F.col("redacted").alias("text"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return got.select(docs.columns)
