"""Similarity, error rates and text features."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.normalize import words


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character edits over reference length; without reference 0 if both are empty, else 1."""
    n = F.char_length(reference)
    return F.when(n > 0, F.levenshtein(reference, hypothesis) / n).otherwise(F.when(F.char_length(hypothesis) == 0, 0.0).otherwise(1.0))


def as_symbols(tokens: Column, vocabulary: Column) -> Column:
    """Tokens as a string with one character per distinct word, so that levenshtein counts words."""
    return F.array_join(F.transform(tokens, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w).cast("int") + 0x4E00), 4, "0")), "UTF-16BE")), "")


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word edits over the words of the reference (up to 20,000 distinct words a pair)."""
    r, h = words(reference), words(hypothesis)
    vocab = F.array_distinct(F.concat(r, h))
    edits = F.levenshtein(as_symbols(r, vocab), as_symbols(h, vocab))
    return F.when(F.size(r) > 0, edits / F.size(r)).otherwise(F.when(F.size(h) == 0, 0.0).otherwise(1.0))


def grade(rate: Column) -> Column:
    return F.when(rate <= 0.02, "A+").when(rate <= 0.05, "A").when(rate < 0.10, "B").when(rate <= 0.20, "C").when(rate <= 0.40, "D").otherwise("F")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def char_set_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.split(a, ""), F.split(b, ""))


def positional_similarity(a: Column, b: Column) -> Column:
    """Equal characters by position over the longer length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) / longest).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    """Of two number arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def scaled_distance(a: Column, b: Column, low: Column, high: Column) -> Column:
    """Euclid over components scaled by their range; constant components count for nothing."""
    part = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), low.alias("l"), high.alias("h")), lambda x: F.when(x["h"] - x["l"] >= 1e-9, F.pow((x["a"] - x["b"]) / (x["h"] - x["l"]), 2)).otherwise(0.0))
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp; no built-in computes it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def align(a: str, b: str) -> list[tuple[str, str]]:
    """Needleman-Wunsch pairs (gap as ''), match 1, else -1; back from the end diagonal before up before left."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    i, j = alignment(x, y)
    return [(a[p] if p >= 0 else "", b[q] if q >= 0 else "") for p, q in zip(i.tolist(), j.tolist())]


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a and b beside each other, -1 for a gap: the one path that the full table would give.

    Only a band of diagonals is filled, whole rows at a time: a row's gaps are a running maximum. The
    band doubles until no path that leaves it could score as much, so ties fall as in the full table.
    Scores are kept for every root-th row and the rows between are made again on the way back, so
    memory is the band times the root of the length. Equal ends are matched first, which is where the
    way back from the end goes anyway.
    """
    least = min(len(a), len(b))
    tail = least if least and (a[len(a) - least :] == b[len(b) - least :]).all() else int(np.argmin(a[len(a) - least :][::-1] == b[len(b) - least :][::-1])) if least else 0
    m, n = len(a) - tail, len(b) - tail
    width = 16
    while True:
        low, high = min(0, n - m) - width, max(0, n - m) + width
        place = np.arange(low, high + 1)  # column j of row i stands at j - i - low
        far = -(4 * (m + n) + 4)

        def below(row: np.ndarray, i: int) -> np.ndarray:
            """Row i of the table from row i - 1."""
            j = place + i
            inside = (j >= 1) & (j <= n)
            same = np.full(len(place), -1)
            same[inside] += 2 * (b[j[inside] - 1] == a[i - 1])
            best = np.maximum(np.where(inside, row + same, far), np.append(row[1:], far) - 1)
            best[(j < 0) | (j > n)] = far
            best[j == 0] = -i
            return np.maximum.accumulate(best + place) - place

        row = np.where((place >= 0) & (place <= n), -place, far)
        step = max(1, int(m**0.5))
        kept = {0: row}
        for i in range(1, m + 1):
            row = below(row, i)
            if i % step == 0:
                kept[i] = row
        score = int(row[n - m - low])
        if width > max(m, n) or score > min(m, n) - 3 * (width + 1) - abs(n - m):
            break
        width *= 2
    i, j, left, right = m, n, [], []
    while i or j:
        first = (max(i - 1, 0) // step) * step
        rows = [kept[first]]
        for r in range(first + 1, i + 1):
            rows.append(below(rows[-1], r))
        while i > first or (i == 0 and j):
            here = rows[i - first][j - i - low]
            if i and j and here == rows[i - 1 - first][j - i - low] + (1 if a[i - 1] == b[j - 1] else -1):
                i, j = i - 1, j - 1
                left.append(i)
                right.append(j)
            elif i and j - i - low + 1 < len(place) and here == rows[i - 1 - first][j - i - low + 1] - 1:
                i -= 1
                left.append(i)
                right.append(-1)
            else:
                j -= 1
                left.append(-1)
                right.append(j)
    ends = np.arange(tail)
    return np.concatenate([np.array(left[::-1], dtype=np.int64), m + ends]), np.concatenate([np.array(right[::-1], dtype=np.int64), n + ends])


def confusions(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """wanted, got, n over the alignments of all rows (gap as ''); counts are summed in each batch first. Null is empty."""

    def run(frames):
        for frame in frames:
            seen: Counter[tuple[str, str]] = Counter()
            for a, b in zip(frame["a"], frame["b"], strict=True):
                if a != b:
                    seen.update(p for p in align(a or "", b or "") if p[0] != p[1])
            yield pd.DataFrame([(x, y, n) for (x, y), n in seen.items()], columns=["wanted", "got", "n"])

    rows = df.select(df[reference].alias("a"), df[hypothesis].alias("b")).mapInPandas(run, "wanted string, got string, n long")
    return rows.groupBy("wanted", "got").agg(F.sum("n").alias("n"))


def top_confusions(df: DataFrame, reference: str, hypothesis: str, top: int = 20, each: int = 3) -> DataFrame:
    """wanted, errors, rank, got, n: for the top characters most often wrong (dropped ones count), what stands for them most often.

    Ties go to the smaller character. A character that is only ever dropped has a row without got.
    """
    seen = confusions(df, reference, hypothesis).where("wanted <> ''")
    worst = seen.groupBy("wanted").agg(F.sum("n").alias("errors")).orderBy(F.desc("errors"), "wanted").limit(top)
    rank = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("n"), "got"))
    named = seen.where("got <> ''").withColumn("rank", rank).where(F.col("rank") <= each)
    return worst.join(named, "wanted", "left").select("wanted", "errors", "rank", "got", "n")


@F.pandas_udf(T.StringType())
def marked_differences(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first text with [old->new], [-old-] and [+new+] where the second differs; null if one is null."""
    marks = {"equal": "{0}", "replace": "[{0}->{1}]", "delete": "[-{0}-]", "insert": "[+{1}+]"}
    out = []
    for x, y in zip(a, b, strict=True):
        codes = [] if x is None or y is None else difflib.SequenceMatcher(None, x, y).get_opcodes()
        out.append(None if x is None or y is None else "".join(marks[tag].format(x[i:k], y[j:l]) for tag, i, k, j, l in codes))
    return pd.Series(out, dtype=object)


def error_by_length(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """length, n, avg_cer: error rates by the length of the reference."""
    return df.groupBy(F.char_length(reference).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg(cer(F.col(reference), F.col(hypothesis))).alias("avg_cer"))


def mean_confidence(tokens: Column) -> Column:
    """Mean of the confidences of array<struct<confidence,...>>; 0 without tokens."""
    total = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + t.confidence)
    return F.when(F.size(tokens) > 0, total / F.size(tokens)).otherwise(0.0)


def entropy(p: Column) -> Column:
    """-sum p ln p of an array of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


# The 30 features in their order, with what stands for a measurement that is absent.
FEATURES = {
    "width": 0.0, "height": 0.0, "aspect_ratio": None, "blur_score": 0.0, "brightness": 0.5, "edge_density": 0.0, "border_noise": 0.0, "contrast": 0.5, "sharpness": 0.5, "text_density": 0.3,
    "whitespace_ratio": 0.2, "horizontal_line_score": 0.0, "vertical_line_score": 0.0, "ink_coverage": 0.3, "skew_score": 0.0, "char_count": None, "word_count": None, "avg_word": None, "digit_ratio": None,
    "arabic_ratio": None, "latin_ratio": None, "punct_ratio": None, "unique_ratio": None, "line_spacing_ratio": 0.3, "margin_uniformity": 0.8, "header_score": 0.0, "footer_score": 0.0, "table_score": 0.0,
    "term_score": None, "confidence_score": 0.5,
}


def text_features(df: DataFrame, text: str, vocabulary: list[str] | None = None) -> DataFrame:
    """df with counts and ratios over all characters of a text column."""
    c, w = F.col(text), F.col("__w")
    n = F.greatest(F.char_length(c), F.lit(1))
    share = lambda p: F.round(F.regexp_count(c, F.lit(p)) / n, 6)
    out = df.withColumn("__w", words(c)).withColumns({
        "char_count": F.char_length(c).cast("long"), "word_count": F.size(w).cast("long"),
        "avg_word": F.round(F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda s, x: s + F.char_length(x)) / F.size(w)).otherwise(0.0), 6),
        "digit_ratio": share("[0-9]"), "arabic_ratio": share("[؀-ۿ]"), "latin_ratio": share("[A-Za-z]"), "punct_ratio": share(r"\p{Punct}"),
        "unique_ratio": F.round(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)), 6),
    })
    if vocabulary:
        known = F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.contains(F.lower(c), t))
        out = out.withColumn("term_score", F.size(known) / len(vocabulary))
    return out.drop("__w")


def feature_vector(df: DataFrame, text: str, vocabulary: list[str], out: str = "features") -> DataFrame:
    """df with the 30 features of FEATURES as array<double>: measurements from columns of their names
    where df has them, else their defaults; text features from the text."""
    own = set(df.columns)
    measured = text_features(df, text, vocabulary)
    value = {k: F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in own and v is not None else F.lit(v) if v is not None else F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if k != "aspect_ratio" else None for k, v in FEATURES.items()}
    value["aspect_ratio"] = value["width"] / F.greatest(value["height"], F.lit(1.0))
    return measured.withColumn(out, F.array(*value.values())).select(*df.columns, out)
