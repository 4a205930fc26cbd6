"""Faults that larger tables and odd inputs showed."""

import datetime as dt
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.functions import detect as D
from lexforge.operators import dedup as U
from lexforge.operators import density
from lexforge.operators import export as X
from lexforge.operators import learn as L
from lexforge.operators import medical as M
from lexforge.operators import review as V
from lexforge.plans.registry import QUERIES
from lexforge.streaming import windows


def test_vote_without_confidence_has_no_share(spark):
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 3.0), (2, "b", 1.0)], "doc long, category string, confidence double")
    got = {r.doc: tuple(r)[1:] for r in V.classification_vote(rows, "doc", "category", "confidence").collect()}
    assert got == {1: ("a", 0.0, None), 2: ("a", 3.0, 0.75)}


def test_open_session_is_not_settled_by_its_first_events(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([(u, at + dt.timedelta(minutes=m)) for u, m in [(1, 0), (1, 20), (2, 0), (3, 0), (3, 30), (3, 59)]], "user long, ts timestamp")
    as_of = lambda minutes: F.unix_micros(F.lit(at + dt.timedelta(minutes=minutes)))
    ends = lambda minutes: sorted((r.user, r.n) for r in windows.settled(rows, "user", "30 minutes", as_of(minutes)).collect())
    assert ends(40) == [(2, 1), (3, 1)]
    assert (1, 2) in ends(50) and ends(100) == [(1, 2), (2, 1), (3, 1), (3, 2)]


def test_highlighted_words_end_at_accents_as_in_the_sql(spark):
    text = "leséré les, Les_ undäge und thé the"
    got = spark.range(1).select(X.highlighted(F.lit(text), ["the", "und", "les"]), X.highlighted(F.lit("été étéé Été, x"), ["été"])).first()
    assert got[0] == "**les**éré **les**, Les_ **und**äge **und** thé **the**"
    assert got[1].startswith("**été** étéé ")


def brute_links(rows, least):
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    links = [(a, b, float(unit[a] @ unit[b])) for a in unit for b in unit if a < b and round(float(unit[a] @ unit[b]), 6) >= least]
    label = {k: k for a, b, _ in links for k in (a, b)}
    for _ in label:
        for a, b, _ in links:
            label[a] = label[b] = min(label[a], label[b])
    sums = {c: [s for a, _, s in links if label[a] == c] for c in set(label.values())}
    return label, {c: sum(s) / len(s) for c, s in sums.items()}


def test_linked_rows_without_listing_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5))
    vectors = [(centres[i % 12] + rng.normal(size=5) * 0.1 * (i % 5)).tolist() for i in range(120)]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)] + [(i, vectors[1]) for i in range(6)] + [(2000 + i, vectors[3]) for i in range(2)]
    frame = spark.createDataFrame(rows + [(5000, None), (5001, [0.0] * 5)], "vec_id long, embedding array<double>")
    for least in (0.97, 0.9995):
        named, links = density.linked_rows(frame, "vec_id", "embedding", least, block=8)
        label, score = brute_links(rows, least)
        assert {r.node: r.component for r in named.collect()} == label
        got = {r.component: r for r in U.merged_clusters(frame, named, links, "vec_id", F.col("vec_id").cast("string")).collect()}
        assert {c: r.n for c, r in got.items()} == dict(Counter(label.values()))
        assert all(abs(got[c].score - s) < 1e-9 for c, s in score.items())


def test_points_travel_once_per_share(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    blocks = density.Blocks(density.unit_points(frame, "vec_id", "embedding")[1], 0.1, block=8)  # 50 cells that rule nothing out
    assert max(len(r.others) for r in blocks.meets.collect()) <= density.SHARES
    assert blocks.points.groupBy("share").count().agg(F.max("count")).first()[0] <= 100


def test_nearest_rows_equal_all_pairs(spark, monkeypatch):
    for name, value in (("_BLOCK", 16), ("QUERIES", 8), ("SHARE", 40)):
        monkeypatch.setattr(L, name, value)
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).round(2) for _ in range(150)] + [np.ones(6)] * 30 + [np.ones(6) + 1e-7 * i for i in range(30)] + [np.zeros(6)] * 2
    x = np.array([v for v in vectors])
    frame = spark.createDataFrame([(int(i), v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    queries = frame.where("vec_id % 7 = 0")
    rounded = lambda v: float(np.trunc(v * 1e6 + np.copysign(0.5, v)) / 1e6)
    near, similar = [], []
    for q in range(0, len(x), 7):
        rest = [i for i in range(len(x)) if i != q]
        near += [(q, i, i % 3, d) for d, i in sorted((rounded(np.sqrt(((x[q] - x[i]) ** 2).sum())), i) for i in rest)[:5]]
        cosine = lambda i: rounded(x[q] @ x[i] / (np.linalg.norm(x[q]) * np.linalg.norm(x[i]))) if x[q].any() and x[i].any() else 0.0  # noqa: B023, E731
        similar += [(q, i, -s) for s, i in sorted((-cosine(i), i) for i in rest if i % 3 == q % 3)[:5]]
    same = lambda got, want: [r[:-1] for r in got] == [r[:-1] for r in want] and np.allclose([r[-1] for r in got], [r[-1] for r in want], atol=1e-9)
    assert same(sorted((r.q, r.d, r.vec_id, r.label) for r in L.nearest(queries, frame, "vec_id", "embedding", ["label"], 5).collect()), sorted((q, d, i, t) for q, i, t, d in near))
    assert same(sorted(map(tuple, L.top_k(queries, frame, "vec_id", "embedding", 5, tenant="label").collect())), sorted(similar))


def test_vectors_without_a_distance_come_last(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, None, "b"), (2, [1.0, None], "c"), (3, [1.0], "d"), (4, [float("nan"), 1.0], "e"), (5, [1.0, 3.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r.q, str(r.d), r.vec_id, r.label) for r in L.nearest(frame.where("vec_id < 2"), frame, "vec_id", "embedding", ["label"], 4).collect())
    assert got == [(0, "1.0", 5, None), (0, "None", 1, "b"), (0, "None", 2, "c"), (0, "nan", 4, "e"), (1, "None", 0, "a"), (1, "None", 2, "c"), (1, "None", 3, "d"), (1, "None", 4, "e")]


def test_neighbours_leave_no_pairs(spark):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 2) for i in range(500)], "vec_id long, embedding array<double>, label int")
    plan = L.nearest(frame.where("vec_id % 10 = 0"), frame, "vec_id", "embedding", ["label"], 5)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_note_text_and_hits_are_computed_once(spark):
    plans = {n: QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for n in ("note_checks", "note_categories")}
    for plan in plans.values():
        assert plan.count("severe asthma") == 1 and plan.count(r"\bfractur") == 1


def test_relations_and_entities_without_a_shuffle(spark):
    text = "Patient was diagnosed with mild knee pain. He was given Aspirin 5 mg for fever. Surgery was performed on the knee"
    rows = spark.createDataFrame([(1, text), (1, "An MRI of the hip."), (2, ""), (3, None)], "k long, t string")
    found = sorted(tuple(r) for r in M.entities(rows, "k", "t").select("k", "kind", "start", "value").collect())
    assert found == [(1, "ANATOMY", 14, "hip"), (1, "ANATOMY", 109, "knee"), (1, "DIAGNOSIS", 12, "diagnosed with mild knee pain"), (1, "MEDICATION", 56, "Aspirin"), (1, "PROCEDURE", 3, "MRI"), (1, "PROCEDURE", 80, "Surgery"), (1, "VALUE", 64, "5 mg")]
    got = M.grounded_relations(rows, "k", "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, M.grounded(M.relations(rows, "k", "t"), M.entities(rows, "k", "t"), "k").select(got.columns).collect()), key=str)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in M.entities(rows, "k", "t")._jdf.queryExecution().executedPlan().toString()


def test_scripts_are_counted_once(spark):
    rows = spark.createDataFrame([(1, "abc ابج"), (2, None), (3, " "), (4, "12")], "k long, t string").select("k", D.language(F.col("t")).alias("l"))
    assert [(r.k, r.l.lang, r.l.confidence) for r in rows.orderBy("k").collect()] == [(1, "mixed", 0.5), (2, "unknown", 0.0), (3, "unknown", 0.0), (4, "mixed", 0.0)]
    plan = rows.select("k", "l.lang", "l.confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z]") <= 2  # once per column at most


def brute_places(tokens, eps):
    label = list(range(len(tokens)))
    near = [(i, j) for i in range(len(tokens)) for j in range(i) if tokens[i][0] == tokens[j][0] and (tokens[i][1] - tokens[j][1]) ** 2 + (tokens[i][2] - tokens[j][2]) ** 2 <= eps * eps]
    for _ in tokens:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    out = Counter()
    for c in set(label):
        held = [t for t, k in zip(tokens, label) if k == c]
        spots = {text: [t for t in held if t[3] == text] for text in {t[3] for t in held}}
        mean = lambda i: sum(sum(t[i] for t in g) / len(g) for g in spots.values()) / len(spots)
        weight = {text: round(sum(0.8 * t[4] * (1 + 0.02 * len(text)) for t in g), 9) for text, g in spots.items()}
        out[held[0][0], round(mean(1), 6), round(mean(2), 6), max(weight, key=lambda t: (weight[t], t))] += 1
    return out


def test_places_of_a_page_are_found_where_it_stands(spark):
    rng = np.random.default_rng(9)
    tokens = [(int(rng.integers(0, 12)) ** 2 // 12, float(rng.integers(-90, 90)), float(rng.integers(0, 160)), "abc"[int(rng.integers(0, 3))], float(rng.integers(55, 99)) / 100) for _ in range(260)]
    shape = "page long, x double, y double, text string, confidence double"
    odd = [(None, 1.0, 1.0, "a", 0.9), (1, float("nan"), 1.0, "a", 0.9), (1, None, 1.0, "a", 0.9), (1, 1.0, 1.0, "a", 0.5), (1, 1.0, 1.0, "a", None)]
    rows = spark.createDataFrame([*tokens, *odd], shape).withColumn("engine", F.lit("other"))
    context = spark.sparkContext
    for most in (256, 8):
        context.setJobGroup(f"places {most}", "")
        got = L.spatial_fusion(rows, "page", [], 15.0, **({"most": most} if most < 256 else {})).collect()
        jobs = len(context.statusTracker().getJobIdsForGroup(f"places {most}"))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert Counter((r.page, r.x, r.y, r.text) for r in got) == brute_places(tokens, 15.0)
        assert most < 256 or jobs < 10, jobs  # no search for components over all tokens


def test_dictionary_reads_texts_in_runs_of_bounded_bytes(spark):
    from lexforge.operators import correct as K
    from lexforge.session import text_runs

    texts = ["x" * 900_000, None, "", "y" * 900_000, "z" * 5_000_000, "a b", "é" * 1_500_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["k", "t"])
    runs = [r.column("k").to_pylist() for r in text_runs(batch, "t")]
    assert runs == [[0, 1, 2, 3], [4], [5], [6]] and not list(text_runs(batch[:0], "t"))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["One two", None, "", " \t", "three ONE one"] * 40)], "id int, text string")
    fixes = spark.createDataFrame([("one", "1"), ("ONE", "0")], "word string, correction string")
    got = {tuple(r) for r in K.apply_dictionary(docs, fixes, "id", "text").collect()}
    assert got == {(k, *v) for k in range(0, 200, 5) for k, v in [(k, ("0 two", 1)), (k + 4, ("three 0 0", 2))]}


def test_archives_are_made_in_runs_of_bounded_bytes():
    from lexforge.plans.archived import _archived

    texts = [str(i) * 700_000 for i in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts), pa.array(["en"] * 9), pa.array([None] * 9, pa.string())], ["doc_id", "text", "lang", "source"])
    got = list(_archived(iter([batch])))
    assert [b.num_rows for b in got] == [2, 2, 2, 2, 1] and [k for b in got for k in b.column("doc_id").to_pylist()] == list(range(9))


def test_characters_vote_without_a_row_each(spark):
    rng = np.random.default_rng(4)
    turns = [(int(rng.integers(0, 9)), "".join("abé\U0001f600 \0"[int(rng.integers(0, 6))] for _ in range(int(rng.integers(0, 40)))), float(rng.integers(50, 99)) / 100) for _ in range(50)]
    turns += [(20, "", 0.5), (21, None, 0.5), (None, "x", 0.5), (22, "xy", None), (22, "zz", 0.9), (23, "x", float("nan")), (23, "y", 0.1), (24, "q", float("inf")), (24, None, 0.5), (24, "qrs", 0.7), (25, "u", -1.0)]
    rows = spark.createDataFrame(turns, "doc long, text string, confidence double")
    plain = L.char_vote(rows, "doc", "text", "confidence")
    assert "Generate" not in plain._jdf.queryExecution().toString()
    got = {r.doc: r.fused for r in plain.collect()}
    assert set(got) == {t[0] for t in turns if t[0] is not None and t[1]}
    for most in (0, 300):
        assert {r.doc: r.fused for r in L.char_vote(rows, "doc", "text", "confidence", most=most).collect()} == got


def test_lineage_joins_only_its_longest_paths(spark, monkeypatch):
    from lexforge.operators import relational as R

    rng = np.random.default_rng(6)
    edges = {(i, i + 1) for i in range(20)} | {(int(a), int(b)) for a, b in rng.integers(0, 25, size=(14, 2))} | {(30, 31), (31, 30), (32, 32)}
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = spark.createDataFrame([*edges, *edges, (40, None)], "child long, parent long")
    got = {(r.child, r.ancestor): r.distance for r in R.lineage(rows, "child", "parent").collect()}
    want, now, step = {}, set(edges), 1
    while now:
        want.update({p: step for p in now})
        now, step = {(a, d) for a, b in now for c, d in edges if b == c} - set(want), step + 1
    assert got == want
    joined = [p for p in plans if "Join" in p]
    assert joined and all("Filter" in p and f"= {2 ** i})" in p for i, p in enumerate(joined))
