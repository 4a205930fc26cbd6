"""Quality rules: document statistics and gradient-boosted trees over them.

Words are runs of characters other than space and tab to carriage return. Null and empty texts
have zero in every statistic and fail the base rule. The trees learn labels.quality from a bounded
sample; with no labels, or one class only, every text that passes the base rule is kept.
Repeated rows are judged alike; a labelled id that repeats is learned from once, by the greatest of
its feature rows, and by the better of its labels; other columns are not looked at, and ids of any
type, null included, come back as they were. A text is one row of statistics whatever its length.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import map_batches, staged, text_of
from lexforge.llm.gbt import BoostedTrees

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
FEATURES = (
    "log_words",
    "mean_word",
    "symbol_ratio",
    "dup_line_ratio",
    "repeat_ratio",
    "upper_ratio",
    "digit_ratio",
    "stop_ratio",
    "unique_ratio",
    "line_words",
    "bang_ratio",
    "long_word_ratio",
    "short_line_ratio",
    "comma_ratio",
)
#: A text never gains by more symbols, repeated lines or repeated words.
MONOTONE = {FEATURES.index(n): -1 for n in ("symbol_ratio", "dup_line_ratio", "repeat_ratio")}
# Frequent function words of the four languages.
STOPS = frozenset(
    b"the of and to in is that it for on with as was be by this are or an at from "
    b"de la le les et des en un une du que est pour dans par sur au qui pas "
    b"der die und den von zu das mit sich des auf ist im dem nicht ein eine als "
    b"el los se del las por con no una su para es al lo como".split()
)
WORD_END = re.compile(rb"[^\x20\x09-\x0D]+")
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(ids: np.ndarray, owner: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Words per document that lie in a width-word window found twice or more in that document.

    ids and owner hold word ids and document numbers of a whole batch, document after document.
    Windows are named exactly: each pass joins names of two shorter windows and renumbers them.
    """
    n = len(ids)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= width:
        names, span = ids.astype(np.int64), 1
        while span < width:
            step = min(span, width - span)
            size = int(names.max()) + 1
            names, _ = pd.factorize(names[: n - span - step + 1] * size + names[step : step + n - span - step + 1] if step == span else names[: n - span - step + 1] * size + names[step : n - span + 1])
            span += step
        starts = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
        keyed, uniques = pd.factorize(names[starts].astype(np.int64) * n_docs + owner[starts])
        again = starts[np.bincount(keyed, minlength=len(uniques))[keyed] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + width, -1)
    return np.bincount(owner, np.cumsum(covered)[:n] > 0, n_docs).astype(np.int64)


def statistics(texts: pd.Series) -> pd.DataFrame:
    """The contract's counts and FEATURES for one batch of texts."""
    rows, words, sizes = [], [], []
    for value in texts:
        text = text_of(value)
        data = text.encode("utf-8", "surrogatepass")
        w = data.split()
        words += w
        n = len(w)
        sizes.append(n)
        chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        dup = lines = short = 0
        for line in data.split(b"\n"):
            if not line or line.isspace():
                continue
            lines += 1
            short += len(line) < 25
            if line in seen:
                dup += 1
            else:
                seen.add(line)
        size, c = max(len(data), 1), max(n, 1)
        upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = len(data) - len(data.translate(None, b"0123456789"))
        stops = sum(map(STOPS.__contains__, data.lower().translate(None, b".,;:!?").split()))
        rows.append((n, chars, symbols, dup, lines, short, upper / size, digits / size, stops / c, len(set(w)) / c, (data.count(b"!") + data.count(b"?")) / size, sum(len(x) > 18 for x in w) / c, data.count(b",") / c))
    owner = np.repeat(np.arange(len(rows)), sizes)
    ids = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
    repeated = repeat_words(ids, owner, len(rows))
    a = np.array(rows, dtype=float).reshape(-1, 13)
    n, lines = np.maximum(a[:, 0], 1), np.maximum(a[:, 4], 1)
    values = {
        "log_words": np.log1p(a[:, 0]),
        "mean_word": a[:, 1] / n,
        "symbol_ratio": a[:, 2] / np.maximum(a[:, 1], 1),
        "dup_line_ratio": a[:, 3] / lines,
        "repeat_ratio": repeated / n,
        "upper_ratio": a[:, 6],
        "digit_ratio": a[:, 7],
        "stop_ratio": a[:, 8],
        "unique_ratio": a[:, 9],
        "line_words": a[:, 0] / lines,
        "bang_ratio": a[:, 10],
        "long_word_ratio": a[:, 11],
        "short_line_ratio": a[:, 5] / lines,
        "comma_ratio": a[:, 12],
    }
    counts = {"n_words": a[:, 0], "word_chars": a[:, 1], "n_symbols": a[:, 2], "n_dup_lines": a[:, 3], "n_repeat_words": repeated}
    return pd.DataFrame({k: v.astype(np.int64) for k, v in counts.items()} | {"features": list(np.stack([values[f] for f in FEATURES], 1))})


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts and features array of every row's whole text."""
    columns = ", ".join(f"{c} long" for c in _COLUMNS)
    got = map_batches(df.select(df[id_col].alias("id"), df[text_col].alias("t")), lambda frame: statistics(frame["t"]), f"{columns}, features array<double>", carry=["id"])
    return got.withColumnRenamed("id", id_col)


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> BoostedTrees:
    """Trees fitted on at most sample_rows labelled documents, the first by a hash of doc_id."""
    picked = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = stats.select("doc_id", "features").join(F.broadcast(picked), "doc_id")  # bounded by sample_rows
    # an id that repeats counts once, with the greatest of its rows, so ids bound what is collected
    got = sample.groupBy("doc_id").agg(F.max("features").alias("features"), F.max("y").alias("y")).orderBy("doc_id").select("y", "features").toPandas()
    x = np.array(got["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return BoostedTrees(monotone=MONOTONE).fit(x, got["y"].to_numpy(float))


def judge(stats: DataFrame, trees: BoostedTrees, threshold: float = 0.5) -> DataFrame:
    """stats with base_failed, score (probability of good quality) and kept."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)  # bounded by rounds and depth

    @F.pandas_udf("double")
    def scored(features: pd.Series) -> pd.Series:
        x = np.array(features.tolist(), dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(shared.value.predict(x), index=features.index)

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("score", scored("features"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: statistics and verdict of every whole text of documents."""
    stats = staged(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality")
    trees = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(stats, trees).select("doc_id", *_COLUMNS, "base_failed", "kept", "score")
