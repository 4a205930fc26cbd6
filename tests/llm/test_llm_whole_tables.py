"""Whitening, filter audit and document fingerprints on small awkward tables, against brute force."""

import hashlib
import random
from collections import Counter
from itertools import permutations
from math import isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import audit, digests, whitening

VECTORS = "vec_id long, embedding array<float>, label int, v string, w int, n string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECTORS)


def whitened_by_hand(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in good], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    z = n * x - sums
    values, vectors = np.linalg.eigh((z / n).T @ (z / n) / n)
    return [i for i, _ in good], n, (z * z).sum(axis=1), z / n, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("dim,count", [(5, 60), (40, 300)])
def test_whitening_equals_eigenvectors(spark, dim, count):
    rng = np.random.default_rng(dim)
    mix = rng.normal(size=(dim, dim))
    rows = [(i, (rng.normal(size=dim) @ mix).astype(np.float32).tolist()) for i in range(count)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, []), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1)), (904, [None] * dim)]
    ids, n, dev, c, values, vectors = whitened_by_hand(rows)
    got = whitening.whiten(vectors_frame(spark, rows).repartition(37)).collect()
    k = min(32, dim)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter(zip(ids, dev.tolist()))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for j in range(k):
        by = {r["vec_id"]: r for r in got if r["component"] == j + 1}
        want = c @ vectors[:, j] / np.sqrt(values[j])
        have = np.array([by[i]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert by[ids[0]]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)


def test_whitening_flat_empty_and_ragged(spark):
    assert whitening.whiten(vectors_frame(spark, [])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(8)]  # rank one
    got = whitening.whiten(vectors_frame(spark, [*line, (50, [1.0]), (51, [1.0, 2.0])])).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(8)) and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def test_whitening_sums_and_deviations_are_exact(spark):
    big = float(2**50)
    rows = [(i, [big + i * 2.0**30, float(i % 3)]) for i in range(6)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    n, sums = whitening.exact_sums(whitening.usable(frame))
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    assert n == 6 and sums == [sum(r[i] for r in x) for i in (0, 1)]
    want = {i: sum((6 * r[j] - sums[j]) ** 2 for j in (0, 1)) for (i, _), r in zip(rows, x)}
    for r in whitening.whiten(frame).where("component = 1").collect():
        assert r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 2**63 else None)


def audit_by_hand(docs, labels):
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    white = " \t\n\x0b\f\r"
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = "".join(" " if ch in white else ch for ch in t).split(" ")
        words = [w for w in words if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= ch <= "Z" for ch in t) > 3 * len(t), "D": any(ch in "#$%&*|" for ch in t), "E": i is not None and i > low[t]}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for p in permutations("ABCDE"):
            for s, f in enumerate(p):
                m = Counter()
                for lang, fails, is_good, is_toxic in rows:
                    if lang == part:
                        early = any(fails[x] for x in p[:s])
                        m["kept"] += not early and not fails[f]
                        m["removed"] += fails[f] and not early
                        m["redundant"] += fails[f] and early
                        m["unique"] += fails[f] and sum(fails.values()) == 1
                        m["good"] += fails[f] and not early and is_good
                        m["toxic"] += fails[f] and not early and is_toxic
                out[part, "".join(p), s + 1] = [m[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    for part in {r[0] for r in rows}:
        for f in "ABCDE":
            total = sum(v[1] for (l, p, s), v in out.items() if l == part and p[s - 1] == f)
            for (l, p, s), v in out.items():
                if l == part and p[s - 1] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    long_ = [" ".join(word() for _ in range(260)) for _ in range(4)]
    texts = [*long_, long_[0], long_[0], "a b " * 150, " ".join(["One", "TWO"] * 120), long_[1] + " 100% # $", None, "", "", " \t\x0b\r\n ", " ".join(["x"] * 300), "é" * 500, long_[2] + " tail", "WORD" * 9000]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(2, long_[2], "en"), (2, long_[2], "de"), (None, long_[0], "en"), (None, long_[3], "fr"), (90, long_[3], "fr"), (91, long_[3], "fr"), (91, long_[3], "fr")]
    labels = [(0, 1, 0), (1, 0, 1), (4, 1, 1), (4, 0, 0), (5, None, 1), (91, 1, None), (None, 1, 1), (777, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force_and_sql(spark, audited):
    docs, labels = audited
    frame = spark.createDataFrame([(*d, "x", 3, 4) for d in docs], "doc_id long, text string, lang string, mask string, n int, step int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(frame, marks)
    rows = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got.collect()}
    assert rows == audit_by_hand(docs, labels) and got.count() == len(rows) == 600 * 4
    con = duckdb.connect()
    documents, labels = frame.select("doc_id", "text", "lang").toPandas(), marks.toPandas()  # noqa: F841  read by name
    known = {(r[0], r[1], r[2]): tuple(r[3:]) for r in con.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({audit.SQL})").fetchall()}
    assert known == rows


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_triplets_and_codes_by_hand():
    rng = random.Random(9)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 4, 50, 3000]))) for _ in range(60)] + [b"", b"x" * (2 * digests.PIECE + 5), b"", b"ab"]
    got = digests.triplet_counts(texts)
    for t, row in zip(texts[:60], got):
        want = Counter(int(digests._TABLES[0][t[i]] ^ digests._TABLES[1][t[i + 1]] ^ digests._TABLES[2][t[i + 2]]) for i in range(len(t) - 2))
        assert {i: int(n) for i, n in enumerate(row) if n} == dict(want)
    assert got.sum(axis=1).tolist() == [max(0, len(t) - 2) for t in texts]
    for t, row, made in zip(texts, got, digests.codes(texts)):
        s = np.sort(row)
        cuts = [s[127], s[255], s[383]]
        assert made[1:].tolist() == [sum(int(c) > q for q in cuts) for c in row.tolist()]
    together, apart = digests.written(digests.codes(texts)), [digests.written(digests.codes([t]))[0] for t in texts]
    assert together == apart and len(set(map(len, apart))) == 1


def followed_by_hand(docs):
    order = sorted(docs, key=lambda r: (-(-(2**63) if r[0] is None else r[0]), r[1] is not None, r[1] or ""))
    out = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]]):
        t, following = t or "", following or ""
        cut = len(t) // 3
        out.append((i, len(t), t, t[: len(t) - cut] + following[:cut], following))
    return out


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_fingerprints_of_followers(spark, parts):
    rng = random.Random(parts)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    docs = [(rng.randrange(10**12) - 10**11, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))) for _ in range(150)]
    docs += [(5, "é" * 40), (6, ""), (7, None), (8, "ab"), (2**62, "z" * 300_000), (-(2**62), "last " * 30), (None, "no id"), (None, None), (11, docs[0][1]), (12, docs[0][1]), (12, docs[0][1]), (12, "other")]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, part string, tail int, t int").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = digests.followed(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    print_of = lambda t: digests.codes([t.encode()])
    want = []
    for i, n, t, edited, following in followed_by_hand(docs):
        a, b, c = print_of(t), print_of(edited), print_of(following)
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), digests.written(a)[0], digests.written(b)[0], float(digests.likeness(a, b)[0]), float(digests.likeness(a, c)[0])))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edits_stay_near_and_others_do_not(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    frame = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(60)], "doc_id long, text string")
    got = digests.followed(frame).collect()
    assert all(r["near_edited"] > 0.4 > r["near_next"] for r in got)
    assert digests.followed(frame.limit(0)).count() == 0
    one = digests.followed(frame.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    alike = digests.followed(frame.select("doc_id", F.lit("the same text").alias("text")))
    assert alike.select("fingerprint").distinct().count() == 1 and alike.where("near_next < 1").count() == 0
