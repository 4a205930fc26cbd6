"""Secret scans: fixed credential shapes plus sliding-window entropy over candidate strings.

Input: a text column. Null text counts as empty and gives no spans; repeated rows give repeated
results; other columns are not read, whatever their names; ids of any type, null included, come back
as they were. Spans of one start are ordered by kind as listed. Every step is per row and linear in
the text, so nothing is shuffled, a hot source costs no more than any other rows, and a text of
megabytes takes seconds.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import map_batches, span_text, text_of

KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
SPANS = "array<struct<start:long,end:long,kind:string,base:boolean>>"

# Fixed values of the scan: the three credential shapes.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

SEPARATOR = re.compile(r"[:=]")
KEY_END = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\Z""", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z")),
    ("alnum", re.compile(r"[A-Za-z0-9]+\Z")),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z")),
)
ALLOWED = (
    r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z",  # UUIDs
    r"(?i)example|sample|dummy|placeholder|changeme|xxxxxx",  # documentation values
    r"\A[A-Za-z]+(?:[-_/=+][A-Za-z]+)*\Z",  # words, paths and identifiers without digits
    r"\A[0-9=_/+-]+\Z",  # numbers, rules of dashes or underscores
    r"\A(?:[A-Za-z]+[0-9]{0,4}[-_/=+]+)+[A-Za-z]*[0-9]{0,4}\Z",  # slugs such as part-0001_of-0008
)


@dataclass(frozen=True)
class EntropyRule:
    """A class's sliding window, in characters, and the bits a window must reach."""

    window: int
    bits: float


RULES = {"hex": EntropyRule(24, 3.0), "alnum": EntropyRule(20, 3.55), "base64": EntropyRule(24, 3.85)}


def window_spans(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) covered by windows whose Shannon entropy reaches bits.

    Counts are kept by incremental updates: one character enters and one leaves per step, and
    the sum of c*log2(c) changes by four table terms. A text shorter than the window has none.
    """
    n = len(text)
    if n < window:
        return []
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, full = 0.0, math.log2(window)
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += clog[c + 1] - clog[c] if c < window else 0.0
        counts[ch] = c + 1
        if i >= window:
            out = text[i - window]
            c = counts[out]
            total += clog[c - 1] - clog[c]
            counts[out] = c - 1
        if i >= window - 1 and full - total / window >= bits - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class SecretScanner:
    """Finds (start, end, kind) in one text; allow is a list of regexes that suppress candidates."""

    def __init__(self, rules: dict[str, EntropyRule] | None = None, allow: tuple[str, ...] = ALLOWED) -> None:
        self.rules = rules or RULES
        self.allow = [re.compile(a) for a in allow]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """The fixed shapes. Searches start at the rare characters a match cannot do without."""
        found = [(s, e, "assign") for s, e in self._assignments(text)]
        for run in CANDIDATE.finditer(text):  # holds every access key and every hex run that is long enough
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, run.start(), run.end())]
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
        return found

    @staticmethod
    def _assignments(text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping ASSIGN matches, found backwards from each ':' or '='."""
        found, end = [], 0
        for sep in SEPARATOR.finditer(text):
            at = sep.start()
            if at < end:
                continue
            back = at
            while back > end and text[back - 1] == " ":
                back -= 1
            key = KEY_END.search(text, max(end, back - 9), back)
            if key and (m := ASSIGN.match(text, key.start())):
                end = m.end()
                if m.end(2) - m.start(2) >= 6:
                    found.append(m.span())
        return found

    def extra(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """High-entropy stretches of candidates, outside the base spans: one walk along both lists."""
        found, at = [], 0
        taken = merged(base)
        for m in CANDIDATE.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            start, k = m.start(), at
            while start < m.end():
                stop = min(taken[k][0], m.end()) if k < len(taken) else m.end()
                found += [(start + s, start + e, "entropy") for s, e in self.windows(text[start:stop])]
                if k == len(taken) or taken[k][0] >= m.end():
                    break
                start, k = max(start, taken[k][1]), k + 1
        return found

    def windows(self, value: str) -> list[tuple[int, int]]:
        """Spans of one candidate, by the rule of the narrowest class that holds it; none if it is allowed."""
        rule = next((self.rules[n] for n, shape in CLASSES if n in self.rules and shape.match(value)), None)
        if rule is None or len(value) < rule.window or any(a.search(value) for a in self.allow):
            return []
        return window_spans(value, rule.window, rule.bits)

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        base = self.base(text)
        return base, self.extra(text, base)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: SecretScanner | None = None) -> DataFrame:
    """id, spans array<struct<start,end,kind,base>> of every row's whole text, in span order."""
    scanner = scanner or SecretScanner()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text in frame["t"]:
            base, extra = scanner.scan(text_of(text))
            spans = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in extra]
            spans.sort(key=lambda x: (x[0], KINDS[x[2]], x[1]))
            out.append([{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in spans])
        return pd.DataFrame({"spans": out})

    got = map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("t")), run, f"spans {SPANS}", carry=["id"])
    return got.withColumnRenamed("id", id_col)


def digest_rows(scanned: DataFrame, id_col: str, named: tuple[str, ...]) -> DataFrame:
    """Contract columns from a spans column in span order: counts of the named base kinds, digest, all spans."""
    base = F.filter("spans", lambda s: s.base)

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in named]
    return scanned.select(id_col, *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: secrets of every whole text of documents, with the digest of the fixed shapes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_rows(scan_secrets(docs), "doc_id", ("assign", "access", "hex"))
