"""Full-text match against a scan of every text."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexforge.operators import positions as P

WORDS = ["alpha", "alpine", "beta", "gamma", "delta", "été", "x1"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = [(i, (", " if i % 3 else " ").join(rng.choice(WORDS).title() for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    return [*out, (200, None), (201, ""), (202, "!!"), (203, "beta " * 4000 + "gamma"), (None, "alpha beta")]


@pytest.fixture(scope="module", params=[None, 3])
def index(spark, texts, request):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, term string, at int").repartition(3)
    return P.positional_index(docs, "doc_id", "text", buckets=4, spread=request.param)


def starts(words, clause):
    kind, parts, extra = clause
    fits = lambda w, i: w.startswith(parts[i]) if extra == "*" and i == len(parts) - 1 else w == parts[i]
    if kind == "near":
        at = [[i for i, w in enumerate(words) if w == p] for p in parts]
        return [i for i in at[0] if all(any(abs(i - j) <= extra + 1 for j in other) for other in at[1:])]
    return [i for i in range(len(words) - len(parts) + 1) if all(fits(words[i + k], k) for k in range(len(parts)))]


CASES = [
    ("beta", [([("is", ["beta"], "")], [])]),
    ("alp*", [([("is", ["alp"], "*")], [])]),
    ('"beta gamma"', [([("is", ["beta", "gamma"], "")], [])]),
    ('"beta alp"*', [([("is", ["beta", "alp"], "*")], [])]),
    ("NEAR(beta delta, 2) été", [([("near", ["beta", "delta"], 2), ("is", ["été"], "")], [])]),
    ('"beta beta beta" OR x1 NOT gamma', [([("is", ["beta"] * 3, "")], []), ([("is", ["x1"], "")], [("is", ["gamma"], "")])]),
    ("delta AND NOT \"gamma alpha\"", [([("is", ["delta"], "")], [("is", ["gamma", "alpha"], "")])]),
    ("nowhere", [([("is", ["nowhere"], "")], [])]),
]


@pytest.mark.parametrize("text,groups", CASES)
def test_match_equals_scan(index, texts, text, groups):
    cut = {i: [w for w in re.split(r"[^\w]+|_", t.lower()) if w] for i, t in texts if t is not None}
    n, mean = len(cut), sum(map(len, cut.values())) / len(cut)
    every = [c for yes, _ in groups for c in yes]
    df = [sum(bool(starts(w, c)) for w in cut.values()) for c in every]
    want = {}
    for i, w in cut.items():
        if any(all(starts(w, c) for c in yes) and not any(starts(w, c) for c in no) for yes, no in groups):
            at = [starts(w, c) for c in every]
            score = sum(math.log((n - d + 0.5) / (d + 0.5) + 1) * len(p) * 2.2 / (len(p) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for p, d in zip(at, df))
            want[i] = (sum(map(len, at)), min(p[0] for p in at if p), round(score, 6))
    got = P.match(index, text).select("doc_id", "hits", "first", F.round("score", 6).alias("score")).collect()
    assert {r["doc_id"]: (r["hits"], r["first"]) for r in got} == {i: v[:2] for i, v in want.items()} and len(got) == len(want)
    assert all(r["score"] == pytest.approx(want[r["doc_id"]][2], abs=2e-6) for r in got)


def test_search_reads_its_buckets_only(index):
    plan = index.segments.where("term = 'beta'")._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.optionalBucketSet().get().cardinality() == 1 and scan.relation().bucketSpec().get().numBuckets() == 4
    assert "EqualTo(term,beta)" in plan.toString()


def test_nothing_to_look_for(spark, index):
    for text in ("", "NOT beta", "!!", "OR"):
        with pytest.raises(ValueError):
            P.match(index, text)
    none = P.positional_index(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert P.match(none, "beta OR alp*").count() == 0


def test_documents_in_one_part_are_dealt_to_tasks_of_bounded_words(spark, texts, monkeypatch):
    monkeypatch.setattr(P, "TASK", 700)
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").coalesce(1)
    index = P.positional_index(docs, "doc_id", "text", buckets=4)
    assert len({re.search(r"part-(\d+)", f).group(1) for f in index.segments.inputFiles()}) > 4
    whole = {r["doc_id"]: r["hits"] for r in P.match(index, '"beta gamma"').collect()}
    cut = {i: re.sub("[^a-zé0-9]+", " ", t.lower()) for i, t in texts if t is not None}
    assert whole == {i: n for i, t in cut.items() if (n := len(re.findall(r"\bbeta(?= gamma\b)", t)))}
