"""Neighbour search and prediction, samplers, fusion of readings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lexforge.session import cut, written


SHARE = 65_536
QUERIES = 16_384
SHARE_BYTES = 1 << 25
SHARES = 16
_BLOCK = 2048
_FIRST, _FINE, _NAN, _NULL = range(4)  # order of a value's class: a cosine of NaN, plain values, a distance of NaN, null


def _exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The cosine or distance of each row of x and y, summed entry by entry, to six places."""
    total = lambda m: np.add.accumulate(m, axis=1)[:, -1] if m.shape[1] else np.zeros(len(m))
    with np.errstate(all="ignore"):
        if metric == "cosine":
            norm = np.sqrt(total(x * x)) * np.sqrt(total(y * y))
            got = np.where(norm <= 0, 0.0, total(x * y) / norm)
        else:
            got = np.sqrt(total((x - y) ** 2))
        return np.trunc(got * 1e6 + np.copysign(0.5, got)) / 1e6


def closest(x: np.ndarray, y: np.ndarray, k: int, metric: str, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, values): for every x the k best y, ties to the first, without y from skip[i, 0] to skip[i, 1].

    A product of blocks leaves the rows that may be among the k best; these alone are compared entry by
    entry. Of equal values the first rows win, so a later block must beat the k-th best.
    """
    with np.errstate(all="ignore"):
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        if metric == "cosine":
            one, two = (m / np.sqrt(np.where(n > 0, n, 1.0))[:, None] for m, n in ((x, xx), (y, yy)))
    n = len(x)
    rows, cols, vals = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    limit = np.full(n, np.inf)
    for at in range(0, len(y), _BLOCK):
        to = min(at + _BLOCK, len(y))
        found = [(rows, cols, vals)]
        for lo in range(0, n, _BLOCK):
            part = slice(lo, min(lo + _BLOCK, n))
            with np.errstate(all="ignore"):
                if metric == "cosine":
                    rough, slack = -(one[part] @ two[at:to].T), np.full(part.stop - lo, 1e-9)
                    bound = limit[part] - 0.4e-6
                else:
                    rough = xx[part, None] + yy[None, at:to] - 2 * (x[part] @ y[at:to].T)
                    slack = 1e-15 * (x.shape[1] + 4) * (xx[part] + yy[at:to].max())
                    bound = np.where(limit[part] > 0.4e-6, (limit[part] - 0.4e-6) ** 2, -np.inf)
                fresh = np.isinf(limit[part]) & (limit[part] > 0)
                kth = k + int((np.clip(skip[part, 1], at, to) - np.clip(skip[part, 0], at, to)).max(initial=0)) - 1
                if fresh.any() and kth < to - at:
                    least = np.partition(rough[fresh], kth, axis=1)[:, kth] + slack[fresh]
                    bound[fresh] = least + 2e-6 if metric == "cosine" else (np.sqrt(np.maximum(least, 0)) + 2e-6) ** 2
                p, q = np.nonzero(~(rough > (bound + slack)[:, None]))
            p, q = p + lo, q + at
            keep = (q < skip[p, 0]) | (q >= skip[p, 1])
            p, q = p[keep], q[keep]
            for i in range(0, len(p), SHARE):
                here = slice(i, i + SHARE)
                found.append((p[here], q[here], _exact(x[p[here]], y[q[here]], metric)))
        rows, cols, vals = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((cols, *reversed(_order(vals, metric)), rows))
        rows, cols, vals = rows[order], cols[order], vals[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols, vals, place = (c[place < k] for c in (rows, cols, vals, place))
        full = place == k - 1
        kind, rank = _order(vals[full], metric)
        limit[rows[full]] = np.where(kind == _FINE, rank, np.where(kind == _FIRST, -np.inf, np.inf))
    return rows, cols, vals


def _order(vals: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Class and rank of values, best first."""
    nan = np.isnan(vals)
    return np.where(nan, _FIRST if metric == "cosine" else _NAN, _FINE), np.where(nan, 0.0, -vals if metric == "cosine" else vals)


def _best(queries: DataFrame, base: DataFrame, key: str, vector: str, keep: list[str], k: int, metric: str, tenant: str | None = None) -> DataFrame:
    """q, key, keep, value: the k best base rows of every query, of the same tenant if one is named.

    Queries and base are dealt in shares and meet share by share; a task gives k rows per query, so no
    pair that is not among them leaves it. Base rows travel once per QUERIES queries. Vectors that are
    null or hold nulls, or differ in length, have no distance, and such pairs come last.
    """
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull())
    size = F.when(whole, F.size(vector)).otherwise(-1)
    v = F.when(whole, F.col(vector)).cast("array<double>")
    team = (F.col(tenant) if tenant else F.lit(0)).cast("string")
    q = queries.select(F.col(key).alias("key"), v.alias("v"), size.alias("n"), team.alias("team")).where("key is not null and team is not null")
    b = base.select(F.col(key).alias("key"), v.alias("v"), size.alias("n"), team.alias("team"), F.struct(F.lit(0).alias("_"), *keep).alias("held")).where("key is not null and team is not null")
    nq, nb = q.count(), b.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("d")).first()
    most = max(1, min(SHARE, SHARE_BYTES // (8 * max(1, nb["d"] or 0))))
    queried, dealt = -(-nq // min(most, QUERIES)) or 1, max(SHARES, -(-nb["n"] // most))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    none = F.lit(None).cast(b.schema["held"].dataType)
    asked = q.select("key", "v", "n", "team", none.alias("held"), F.lit(True).alias("asks"), of(queried).alias("s"), every(dealt).alias("t"))
    given = b.select("key", "v", "n", "team", "held", F.lit(False).alias("asks"), every(queried).alias("s"), of(dealt).alias("t"))
    missing = 0.0 if metric == "cosine" else None  # as cosine() has it

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        ask, give = frame[frame["asks"]], frame[~frame["asks"]].sort_values("key", ignore_index=True)
        teams = {t: g.reset_index(drop=True) for t, g in give.groupby("team")}

        def add(keys: np.ndarray, rows: pd.DataFrame, values: np.ndarray, null: bool = False) -> None:
            kind = np.where(np.isnan(values), _NAN, _FINE) if not null else np.full(len(rows), _NULL)
            out.append(pd.DataFrame({"q": keys, "key": rows["key"].to_numpy(), "held": rows["held"].to_numpy(), "kind": kind.astype(np.int32), "value": values}))

        for (team, n), mine in ask.groupby(["team", "n"]):
            rows = teams.get(team)
            if rows is None:
                continue
            like = rows[rows["n"] == n].reset_index(drop=True) if n >= 0 else rows[:0]
            if len(like):
                keys = like["key"].to_numpy()
                skip = np.stack([np.searchsorted(keys, mine["key"].to_numpy(), side) for side in ("left", "right")], axis=1)
                x, y = (np.stack(f["v"].to_list()).astype(np.float64).reshape(len(f), -1) for f in (mine, like))
                i, j, value = closest(x, y, k, metric, skip)
                add(mine["key"].to_numpy()[i], like.iloc[j], value)
            for other, value in ((rows[(rows["n"] < 0) | (n < 0)], missing), (rows[(rows["n"] >= 0) & (rows["n"] != n) & (n >= 0)], None)):
                for one in mine["key"] if len(other) else ():
                    first = other[other["key"] != one][:k]
                    add(np.full(len(first), one), first, np.full(len(first), value or 0.0), null=value is None)
        return pd.concat(out) if out else pd.DataFrame(columns=["q", "key", "held", "kind", "value"], dtype=object)

    named = StructType([StructField("q", b.schema["key"].dataType), b.schema["key"], b.schema["held"], StructField("kind", IntegerType()), StructField("value", DoubleType())])
    got = asked.unionByName(given).groupBy("s", "t").applyInPandas(run, named)
    value = F.when(F.col("kind") == _NAN, float("nan")).when(F.col("kind") == _FINE, F.col("value"))  # pandas has no null beside NaN
    order = value.desc_nulls_last() if metric == "cosine" else value.asc_nulls_last()
    got = got.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(order, "key"))).where(F.col("r") <= k)
    return got.select("q", F.col("key").alias(key), *[F.col("held")[c].alias(c) for c in keep], value.alias("value"))


def top_k(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, tenant: str | None = None, least: float | None = None) -> DataFrame:
    """q, key, similarity: the k most similar base rows by cosine, of the same tenant if one is named."""
    got = _best(queries, base, key, vector, [], k, "cosine", tenant).withColumnRenamed("value", "similarity")
    return got if least is None else got.where(F.col("similarity") >= least)


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, keep: list[str], k: int) -> DataFrame:
    """q, key, keep, d: the k base rows of least Euclidean distance."""
    return _best(queries, base, key, vector, keep, k, "distance").withColumnRenamed("value", "d")


def knn_predict(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """q, label, confidence: distance-weighted vote; confidence blends the vote with nearness."""
    near = cut(nearest(queries, base, key, vector, [label], k))
    votes = near.groupBy("q", label).agg(F.sum(1 / F.greatest("d", F.lit(1e-6))).alias("w"))
    per = near.groupBy("q").agg(F.sum(1 / F.greatest("d", F.lit(1e-6))).alias("total"), F.avg("d").alias("avg_d"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("w", 6)), label))).where("r = 1")
    close = F.least(F.greatest(1 - 0.8 * F.col("avg_d"), F.lit(0.0)), F.lit(1.0))
    conf = F.least(F.greatest(0.6 * F.col("w") / F.col("total") + 0.4 * close, F.lit(0.3)), F.lit(0.98))
    return best.join(per, "q").select("q", label, F.bround(conf, 4).alias("confidence"))


def knn_regress(queries: DataFrame, base: DataFrame, key: str, vector: str, targets: dict[str, tuple[float, float]], k: int = 5) -> DataFrame:
    """q and each target: weighted mean of the k nearest, rounded and held in its range."""
    near = nearest(queries, base, key, vector, list(targets), k)
    w = F.when(F.col("d") < 0.001, 1000.0).otherwise(1 / F.col("d"))
    return near.groupBy("q").agg(*[F.least(F.greatest(F.round(F.sum(w * F.col(t)) / F.sum(w)), F.lit(lo)), F.lit(hi)).alias(t) for t, (lo, hi) in targets.items()])


def farthest_points(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, step: k points, each the farthest from those before, from the smallest key on.

    The method is sequential: every step is one distributed pass that keeps the distance to the
    nearest chosen point; only the chosen point travels.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.lit(None).cast("double").alias("d"))
    first = rows.agg(F.min_by(F.struct("key", "v"), "key").alias("c")).first()["c"]
    chosen = [(first["key"], 0)]
    point = first["v"]
    for step in range(1, k):
        p = F.array(*map(F.lit, point))
        d = F.sqrt(F.aggregate(F.zip_with("v", p, lambda a, b: F.pow(a.cast("double") - b, 2)), F.lit(0.0), lambda s, x: s + x))
        rows = rows.withColumn("d", F.round(F.least(F.coalesce("d", d), d), 9))
        c = rows.agg(F.max_by(F.struct("key", "v"), F.struct("d", -F.col("key"))).alias("c")).first()["c"]
        chosen.append((c["key"], step))
        point = c["v"]
    return df.sparkSession.createDataFrame(chosen, f"{key} long, step int")


def committee_disagreement(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """key, disagreement: one less the share of the most frequent vote."""
    counts = votes.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg((1 - F.max("n") / F.sum("n")).alias("disagreement"))


def kmeans_sample(df: DataFrame, key: str, vector: str, clusters: int, per_cluster: int, seed: int = 42) -> DataFrame:
    """key, cluster: per_cluster rows of each k-means cluster, by a hash of the key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    got = KMeans(k=clusters, seed=seed, maxIter=10).fit(rows).transform(rows)
    rank = F.row_number().over(Window.partitionBy("prediction").orderBy(F.xxhash64(key, F.lit(seed)), key))
    return got.withColumn("r", rank).where(F.col("r") <= per_cluster).select(key, F.col("prediction").alias("cluster"))


def vote_weight(confidence: Column) -> Column:
    return F.pow(confidence, 1.5)


def best_confidence(df: DataFrame, doc: str, engine: str, text: str, confidence: str, priority: dict[str, int] | None = None, order: str | None = None) -> DataFrame:
    """doc, text, engine, confidence of the most confident engine, ties by priority, then name, then the last by order."""
    rank = F.create_map(*[F.lit(x) for kv in (priority or {"": 0}).items() for x in kv])[F.col(engine)]
    best = F.max_by(F.struct(text, engine, confidence), F.struct(F.col(confidence), F.coalesce(rank, F.lit(0)), F.col(engine), *([F.col(order)] if order else [])))
    return df.groupBy(doc).agg(best.alias("b")).select(doc, f"b.{text}", f"b.{engine}", f"b.{confidence}")


def smart_fallback(df: DataFrame, doc: str, engine: str, text: str, confidence: str, gap: float = 0.15) -> DataFrame:
    """doc, choice: best where the first leads by gap, else vote; one engine is best by itself."""
    order = F.reverse(F.array_sort(F.collect_list(confidence)))
    got = df.groupBy(doc).agg(order.alias("c"))
    lead = F.get("c", F.lit(0)) - F.coalesce(F.get("c", F.lit(1)), F.lit(-1.0))
    return got.select(doc, F.when(F.round(lead, 9) >= gap, "best").otherwise("vote").alias("choice"))


def word_vote(df: DataFrame, doc: str, text: str, confidence: str, y: str) -> DataFrame:
    """doc, fused: every distinct lower-cased word once, by mean height, length and itself."""
    words = df.select(doc, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("w"), vote_weight(F.col(confidence)).alias("c"), F.col(y).cast("double").alias("y"))
    best = words.groupBy(doc, "w").agg(F.max("c").alias("c"), F.round(F.avg("y"), 6).alias("y"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", F.char_length("w").alias("n"), "w"))), lambda x: x.w)
    return best.groupBy(doc).agg(F.array_join(ordered, " ").alias("fused"))


READINGS = 32_768


def _voted(texts: list[str], weights: list[float | None]) -> str:
    """Per position the character of most weight, ties to the smallest; a character without any weight comes first, one of NaN last."""
    n = max(map(len, texts))
    codes = np.stack([np.frombuffer(t.ljust(n, "\0").encode("utf-32-le"), dtype=np.uint32) for t in texts])
    w = np.array([np.nan if x is None else x for x in weights], dtype=float)
    given = np.array([x is not None for x in weights])
    order = np.argsort(codes, axis=0, kind="stable").T  # by position, then character
    sorted_ = np.take_along_axis(codes.T, order, axis=1).ravel()
    place = np.repeat(np.arange(n), len(texts))
    first = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (place[1:] != place[:-1])]))
    held = given[order].ravel()
    total = np.add.reduceat(np.where(held, w[order].ravel(), 0.0), first)
    kind = np.where(np.add.reduceat(held.astype(np.int64), first) == 0, 0, np.where(np.isnan(total), 2, 1))
    with np.errstate(all="ignore"):
        value = np.where(kind == 1, -np.floor(total * 1e9 + 0.5), 0.0)
    best = np.lexsort((sorted_[first], value, kind, place[first]))
    best = best[np.flatnonzero(np.diff(place[first][best], prepend=-1))]
    return sorted_[first][best].tobytes().decode("utf-32-le").replace("\0", "")


@F.arrow_udf(returnType=StringType())
def _char_voted(texts: pa.Array, weights: pa.Array) -> pa.Array:
    return pa.array([_voted(t.as_py(), w.as_py()) for t, w in zip(texts, weights, strict=True)], pa.string())


def char_vote(df: DataFrame, doc: str, text: str, confidence: str, most: int = READINGS) -> DataFrame:
    """doc, fused: per position the character of most weight, ties to the smallest; padding can win.

    The readings of a document of up to most padded characters are one row and vote where it stands;
    those of a larger one give a row per character.
    """
    rows = df.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, F.col(text).alias("t"), vote_weight(F.col(confidence)).cast("double").alias("c"))
    size = rows.groupBy(doc).agg(F.max(F.char_length("t")).alias("n"), F.count(F.lit(1)).alias("m"))
    crowded = written(size.where(F.col("n").cast("long") * F.col("m") > most).select(doc, "n"))
    whole = rows.join(crowded, doc, "left_anti").groupBy(doc).agg(F.collect_list(F.struct("t", "c")).alias("r"), F.max(F.char_length("t")).alias("n")).where("n > 0")
    got = whole.select(doc, _char_voted(F.col("r.t"), F.col("r.c")).alias("fused"))
    if not crowded.limit(1).count():
        return got
    each = rows.join(crowded, doc).select(doc, F.posexplode(F.split(F.rpad("t", F.col("n"), "\x00"), "")).alias("i", "ch"), "c")
    votes = each.where(F.col("ch") != "").groupBy(doc, "i", "ch").agg(F.round(F.sum("c"), 9).alias("w"))
    best = votes.groupBy(doc, "i").agg(F.min_by("ch", F.struct(-F.col("w"), "ch")).alias("ch"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x.ch)
    return got.unionByName(best.groupBy(doc).agg(F.replace(F.array_join(ordered, ""), F.lit("\x00"), F.lit("")).alias("fused")))


# Weights of the reading engines.
ENGINE_WEIGHTS = {"tesseract": 0.85, "easyocr": 0.95, "paddleocr": 0.92, "trocr": 0.88, "surya": 0.90, "mixed": 0.93}


PAGE = 256


@F.arrow_udf(returnType=ArrayType(IntegerType()))
def _near_parts(xs: pa.Array, ys: pa.Array, eps: pa.Array) -> pa.Array:
    """Per page the part of every point, named by its first point; points within eps are linked, pages meet no other."""
    sizes = pc.list_value_length(xs).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys))
    reach, left = np.repeat(eps.to_numpy(zero_copy_only=False) ** 2, sizes), np.repeat(ends, sizes) - np.arange(len(x))
    root, at = np.arange(len(x)), np.arange(len(x))
    links = [(at[:0], at[:0])]
    for step in range(1, int(sizes.max(initial=0))):
        at = at[left[at] > step]
        near = at[(x[at] - x[at + step]) ** 2 + (y[at] - y[at + step]) ** 2 <= reach[at]]
        links.append((near, near + step))
    a, b = (np.concatenate(c) for c in zip(*links))
    while len(a):
        p, q = root[a], root[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    starts = ends - sizes
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(root - np.repeat(starts, sizes), pa.int32()))


def _crowded_places(tokens: DataFrame, page: str, eps: float) -> DataFrame:
    """tokens with component, for pages of any size: cells inside eps are parts already, and are linked over points within eps of each other."""
    from lexforge.operators.dedup import components

    side, wide = 0.7 * eps, F.array(*[F.lit(i) for i in range(-2, 3)])
    tokens = tokens.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    cells = cut(tokens.select(page, "cx", "cy").distinct().withColumn("id", F.monotonically_increasing_id()))
    points = cut(tokens.select(page, "cx", "cy", "x", "y").distinct().join(cells, [page, "cx", "cy"]))
    ahead = points.withColumn("dx", F.explode(wide)).withColumn("dy", F.explode(wide)).where("dx > 0 or dx = 0 and dy > 0")
    a, b = ahead.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).alias("a"), points.alias("b")
    same = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    linked = a.join(b, same & (F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) <= eps * eps)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    named = cells.join(components(linked).withColumnRenamed("node", "id"), "id", "left").select(page, "cx", "cy", F.coalesce("component", "id").alias("component"))
    return tokens.join(named, [page, "cx", "cy"]).drop("cx", "cy")


def spatial_fusion(tokens: DataFrame, page: str, terms: list[str], eps: float = 15.0, least: float = 0.55, most: int = PAGE) -> DataFrame:
    """page, x, y, text, confidence: tokens (engine, text, confidence, x, y centres) fused per place.

    Tokens of least confidence or more are linked within eps; places are the components, and the text
    of most weight wins. A page of up to most tokens is one row, whose places are found where it stands;
    the tokens of a larger page stay rows and meet over a grid. Tokens without a page or a finite place are left out.
    """
    weight = F.coalesce(F.create_map(*[F.lit(v) for kv in ENGINE_WEIGHTS.items() for v in kv])[F.col("engine")], F.lit(0.8))
    bonus = F.when(F.lower("text").isin([t.lower() for t in terms]), 1.4).otherwise(1.0) if terms else F.lit(1.0)
    placed = [F.abs(F.col(c).cast("double")) < float("inf") for c in "xy"]  # not so for a null or NaN
    kept = tokens.where((F.col("confidence") >= least) & F.col(page).isNotNull() & placed[0] & placed[1]).withColumn("w", F.col("confidence") * weight * bonus * F.least(1 + 0.02 * F.char_length("text"), F.lit(1.3))).select(page, "x", "y", "text", "w")
    crowded = written(kept.groupBy(page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(page))
    pages = kept.join(crowded, page, "left_anti").groupBy(page).agg(F.collect_list(F.struct("x", "y", "text", "w")).alias("t"))
    parts = pages.withColumn("part", _near_parts(F.col("t.x").cast("array<double>"), F.col("t.y").cast("array<double>"), F.lit(float(eps))))
    places = parts.select(page, F.explode(F.arrays_zip("t", "part")).alias("r")).select(page, "r.t.x", "r.t.y", "r.t.text", "r.t.w", F.col("r.part").cast("long").alias("component"))
    found = _fused(places, page)
    if crowded.limit(1).count():
        found = found.unionByName(_fused(_crowded_places(kept.join(crowded, page), page, eps), page))
    return found


def _fused(places: DataFrame, page: str) -> DataFrame:
    """page, x, y, text, confidence per component of a page."""
    votes = places.groupBy(page, "component", "text").agg(F.sum("w").alias("w"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    got = votes.groupBy(page, "component").agg(F.max_by("text", F.struct("w", "text")).alias("text"), (F.max("w") / F.sum("w")).alias("agree"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    conf = F.least(F.lit(1.0), 1.15 * F.col("agree") + 0.05) * F.when((F.col("n") > 3) & (F.col("agree") < 0.5), 0.8).otherwise(1.0)
    return got.select(page, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "text", F.round(conf, 6).alias("confidence"))
