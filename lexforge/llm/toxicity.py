"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of a text, so
that pairs such as an insult with a group mention can count for more than the two apart. Terms are
the lower-cased letter runs of the whole text and their prefixes, which carry over to unseen
endings. Null and empty texts score sigmoid(b). Labels are only ever read for the bounded training
sample; with no labels, or one class only, the score is the smoothed rate of toxic labels.
Repeated rows score alike; an id that repeats is learned from once, by the text of greatest hash and
the worse of its labels; other columns are not looked at; a text of any length is one set of terms.
Ties of gain go to the smaller bucket.

The machine has the terms whose own log-likelihood gain with the label is beyond what chance gives
the best of all terms looked at (2 ln of their number), and of the pair_terms most telling frequent
terms those whose pairs gain that much more than the two apart, whatever their own gain: a term that
tells only beside another is kept. Terms are counted by Spark over the sample; the driver gets the
counts of kept terms and, for each sample row, its kept terms.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import map_batches, staged, text_of

LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class FactorizationMachine:
    """Weights of the active buckets; other buckets weigh nothing."""

    bits: int = 20
    prefixes: tuple[int, ...] = (4, 5, 6)
    rank: int = 4
    bias: float = 0.0
    active: dict[int, int] = field(default_factory=dict)
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))

    def terms(self, chunk: str) -> list[int]:
        """Buckets of one run of non-space characters."""
        mask, out = (1 << self.bits) - 1, []
        for word in LETTERS.findall(chunk.lower()):
            out.append(zlib.crc32(word.encode()) & mask)
            for n in self.prefixes:
                if len(word) > n:
                    out.append(zlib.crc32(f"{word[:n]}*".encode()) & mask)
        return out

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """b + linear part + pairwise part for rows of distinct active indexes."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        out = np.full(len(rows), self.bias)
        if not sizes.sum():
            return out
        flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
        out += np.bincount(owner, self.linear[flat], len(rows))
        for f in range(self.factors.shape[1]):
            v = self.factors[flat, f]
            out += 0.5 * (np.bincount(owner, v, len(rows)) ** 2 - np.bincount(owner, v * v, len(rows)))
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
        """Weighted logistic loss by Adam on the full sample, L2 on weights and factors; rows hold active indexes."""
        p0 = float(np.clip((weight @ y + 0.5) / (weight.sum() + 1), 1e-4, 1 - 1e-4))
        self.bias = float(np.log(p0 / (1 - p0)))
        m = len(self.active)
        if not m or not len(y) or y.min() == y.max():
            self.active, self.linear, self.factors = {}, np.zeros(0), np.zeros((0, self.rank))
            return self
        sizes = np.array([len(r) for r in rows])
        flat, owner, n = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes), len(rows)
        rng = np.random.default_rng(seed)
        theta = np.concatenate([[self.bias], np.zeros(m), rng.normal(0, 0.02, m * self.rank)])
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        share = weight / weight.sum()
        for step in range(1, epochs + 1):
            v = theta[1 + m :].reshape(m, self.rank)
            picked = v[flat]
            sums = np.stack([np.bincount(owner, picked[:, f], n) for f in range(self.rank)], 1)
            squares = np.bincount(owner, (picked**2).sum(1), n)
            margin = theta[0] + np.bincount(owner, theta[1 : 1 + m][flat], n) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * share
            gv = np.stack([np.bincount(flat, g[owner] * (sums[owner, f] - picked[:, f]), m) for f in range(self.rank)], 1)
            grad = np.concatenate([[g.sum()], np.bincount(flat, g[owner], m), gv.ravel()])
            grad[1:] += decay * theta[1:]
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        self.bias, self.linear, self.factors = float(theta[0]), theta[1 : 1 + m], theta[1 + m :].reshape(m, self.rank)
        return self


def gain_of(n, pos, rate: float):
    """Twice the log-likelihood that n labels with pos toxic ones gain by a rate of their own."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.nan_to_num(pos * np.log(pos / (n * rate))) + np.nan_to_num((n - pos) * np.log((n - pos) / (n * (1 - rate)))))


def split_gain(n, pos, total: float, total_pos: float):
    """Gain of telling the n rows with pos toxic ones from the rest of total rows with total_pos."""
    rate = total_pos / total
    return gain_of(n, pos, rate) + gain_of(total - n, total_pos - pos, rate)


def telling_pairs(on: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Columns of the boolean matrix on (rows x terms) that have a pair which tells more than the two apart."""
    total, total_pos = float(weight.sum()), float(weight @ y)
    k = on.shape[1]
    if k < 2 or not 0 < total_pos < total:
        return np.zeros(0, dtype=np.int64)
    x, rate = on.astype(np.float32), total_pos / total
    both = (x * weight[:, None].astype(np.float32)).T @ x
    both_pos = (x * (weight * y)[:, None].astype(np.float32)).T @ x
    n, pos = np.diag(both).astype(float), np.diag(both_pos).astype(float)
    own = split_gain(n, pos, total, total_pos)
    least = 2 * np.log(k * k) + 10
    found: set[int] = set()
    for i in range(k):
        cells = [(both[i], both_pos[i]), (n[i] - both[i], pos[i] - both_pos[i]), (n - both[i], pos - both_pos[i]), (total - n - n[i] + both[i], total_pos - pos - pos[i] + both_pos[i])]
        gain = sum(gain_of(np.maximum(c, 0).astype(float), np.clip(p, 0, np.maximum(c, 0)).astype(float), rate) for c, p in cells)
        gain = gain - own[i] - own
        gain[i] = 0
        hits = np.flatnonzero(gain >= least)
        if len(hits):
            found.update([i, *hits.tolist()])
    return np.array(sorted(found), dtype=np.int64)


def _rows_of(texts: pd.Series, model: FactorizationMachine) -> tuple[list[np.ndarray], list[int]]:
    """Distinct buckets of each text, and a near-copy signature: the least hash of its word pairs."""
    rows, signs = [], []
    for text in texts:
        chunks = text_of(text).split()
        codes = np.array([zlib.crc32(c.encode("utf-8", "surrogatepass")) for c in chunks], dtype=np.uint64)
        with np.errstate(over="ignore"):
            pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        signs.append(int(pairs.min() >> np.uint64(1)) if len(pairs) else -1)
        rows.append(np.unique(np.array([t for c in set(chunks) for t in model.terms(c)], dtype=np.int32)))
    return rows, signs


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 16_000, pair_terms: int = 768, most_terms: int = 16_384, model: FactorizationMachine | None = None) -> FactorizationMachine:
    """Fit on at most sample_rows labelled documents, the first by a hash of doc_id.

    Rows with crc32(doc_id) mod 4 = 2, null labels and null ids are never learned from. The ids of
    the sample are broadcast (at most sample_rows). At most most_terms terms of the highest own gain,
    and pair_terms frequent ones looked at in pairs, reach the driver. Near copies share one unit of
    weight.
    """
    model = model or FactorizationMachine()
    picked = (
        labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = documents.select("doc_id", documents["text"].alias("t")).join(F.broadcast(picked), "doc_id")

    def extract(frame: pd.DataFrame) -> pd.DataFrame:
        rows, signs = _rows_of(frame["t"], model)
        return pd.DataFrame({"sign": signs, "terms": rows, "hash": [zlib.crc32(text_of(t).encode()) for t in frame["t"]]})

    got = map_batches(sample, extract, "sign long, terms array<int>, hash long", carry=["doc_id", "y"])
    got = got.groupBy("doc_id").agg(F.max(F.struct("hash", "sign", "terms")).alias("x"), F.max("y").alias("y"))
    rows = staged(got.select("y", "x.sign", "x.terms"), "toxic-sample")
    sizes = rows.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).select("sign", F.when(F.col("sign") < 0, 1.0).otherwise(1 / F.col("n")).alias("w"))
    rows = staged(rows.join(sizes, "sign").select("y", "w", "terms"), "toxic-rows")
    total, total_pos = (float(x or 0) for x in rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first())
    if not 0 < total_pos < total:
        y = rows.select("y", "w").toPandas()
        return model.fit([], y["y"].to_numpy(float), y["w"].to_numpy(float))
    counts = rows.select("y", "w", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")).where("n >= 3")
    rate = total_pos / total
    part = lambda n, x, r: F.when(x > 1e-9, 2 * x * F.ln(x / (n * r))).otherwise(0.0)
    both = lambda n, pos: part(n, pos, rate) + part(n, n - pos, 1 - rate)
    n, pos = F.col("n"), F.col("pos")
    counts = staged(counts.withColumn("gain", both(n, pos) + both(total - n, total_pos - pos)), "toxic-terms")
    least = max(7.0, 2 * float(np.log(max(counts.count(), 1))))
    own = [r["term"] for r in counts.where(F.col("gain") >= least).orderBy(F.desc("gain"), "term").limit(most_terms).collect()]
    # the frequent ones: a term that nearly all or nearly no rows have cannot tell much in any pair
    often = [r["term"] for r in counts.orderBy(F.desc(n * (total - n)), "term").limit(pair_terms).collect()]
    known = {t: i for i, t in enumerate(dict.fromkeys([*own, *often]))}
    shared = documents.sparkSession.sparkContext.broadcast(known)  # at most most_terms + pair_terms

    def narrowed(frame: pd.DataFrame) -> pd.DataFrame:
        held = shared.value
        return pd.DataFrame({"k": [np.array([held[t] for t in r.tolist() if t in held], "<i4").tobytes() for r in frame["terms"]]})

    data = map_batches(rows, narrowed, "k binary", carry=["y", "w"]).toPandas()
    y, w = data["y"].to_numpy(float), data["w"].to_numpy(float)
    kept = [np.frombuffer(b, "<i4") for b in data["k"]]
    place = np.array([known[t] for t in often], dtype=np.int64)
    column = np.full(len(known), -1, dtype=np.int64)
    column[place] = np.arange(len(place))
    on = np.zeros((len(kept), len(place)), dtype=bool)
    for i, r in enumerate(kept):
        c = column[r]
        on[i, c[c >= 0]] = True
    names = list(known)
    chosen = dict.fromkeys([*own, *(names[place[j]] for j in telling_pairs(on, y, w))])
    model.active = {t: i for i, t in enumerate(chosen)}
    index = np.array([model.active.get(t, -1) for t in names], dtype=np.int64)
    return model.fit([(i := index[r])[i >= 0] for r in kept], y, w)


def score_texts(texts: pd.Series, model: FactorizationMachine, hot: dict[str, tuple[int, ...]], cold: set[str], remember: int = 200_000) -> np.ndarray:
    """Scores of one batch; only chunks that hold an active term, or are new, are looked at one by one."""
    rows = []
    for text in texts:
        found: set[int] = set()
        for chunk in set(text_of(text).split()).difference(cold):
            hit = hot.get(chunk)
            if hit is None:
                hit = tuple(model.active[t] for t in model.terms(chunk) if t in model.active)
                if hit:
                    hot[chunk] = hit
                else:
                    cold.add(chunk)
            found.update(hit)
        if len(cold) + len(hot) > remember:
            cold.clear()
            hot.clear()
        rows.append(np.array(sorted(found), dtype=np.int64))
    return 1 / (1 + np.exp(-np.clip(model.margins(rows), -30, 30)))


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with out_col, the probability of a toxic label, appended (replacing a column of that name)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    hot: dict[str, tuple[int, ...]] = {}
    cold: set[str] = set()

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts, shared.value, hot, cold), index=texts.index)

    return df.withColumn(out_col, scored(df[text_col]))


def query(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """op10: score of every whole text of documents; labels of the held-out quarter are unseen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model).drop("text")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Pipeline stage: the rows of docs whose score is below threshold, all columns as they were.

    Rows are judged one by one, so repeated rows stay or go together; null and empty texts have the
    score of a text without known terms.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    given = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(docs.columns)))
    clean = score(given, model, f"k{docs.columns.index('text')}", "toxicity").where(F.col("toxicity") < threshold)
    return clean.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
