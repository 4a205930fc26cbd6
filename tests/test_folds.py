"""State machines and other queries without SQL, against plain Python over the same rows."""

import difflib
import os
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexforge.operators import extend as E
from lexforge.operators import learn as L
from lexforge.plans.registry import QUERIES
from lexforge.streaming import state

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def by_user():
    out = defaultdict(list)
    for r in rows("events"):
        out[str(r["user_id"])].append((r["ts"].timestamp(), r["event_id"], r["event_type"] != "error"))
    return {k: sorted(v) for k, v in out.items()}


def test_rate_limiter_by_hand(spark):
    want = {}
    for key, events in by_user().items():
        hits, bad, until = [], [], None
        for t, i, _ in events:
            if until is not None and t < until:
                want[key, i] = (False, True)
                continue
            hits = [h for h in hits if h > t - 21600]
            ok = len(hits) < 2
            if ok:
                hits.append(t)
            else:
                bad = [b for b in bad if b > t - 3600] + [t]
                if len(bad) >= 3:
                    until, bad = t + 7200, []
            want[key, i] = (ok, False)
    got = {(r.key, r.id): (r.allowed, r.penalised) for r in QUERIES["rate_limiter_fold"](spark, DATA).collect()}
    assert got == want and len({v for v in want.values()}) > 1


def test_breaker_by_hand(spark):
    want = {}
    for key, events in by_user().items():
        mode, run, good, tried, since = "closed", 0, 0, 0, 0.0
        for t, i, ok in events:
            if mode == "open" and t - since >= 3600:
                mode, good, tried = "half_open", 0, 0
            if mode == "open" or mode == "half_open" and tried >= 3:
                want[key, i] = (mode, False)
                continue
            tried += mode == "half_open"
            run = 0 if ok else run + 1
            good = good + 1 if ok else good
            if not ok and (mode == "half_open" or run >= 2):
                mode, since = "open", t
            elif ok and mode == "half_open" and good >= 2:
                mode, run = "closed", 0
            want[key, i] = (mode, True)
    got = {(r.key, r.id): (r.state, r.passed) for r in QUERIES["breaker_fsm"](spark, DATA).collect()}
    assert got == want and {m for m, _ in want.values()} >= {"closed", "open"}


def test_cooldown_by_hand(spark):
    alerts = sorted((r.bucket, r.above) for r in QUERIES["threshold_alerts"](spark, DATA).collect())
    last, want = None, {}
    for t, above in alerts:
        want[t] = above and (last is None or t - last >= 7200)
        last = t if want[t] else last
    assert {r.id: r.fired for r in QUERIES["alerts_cooldown"](spark, DATA).collect()} == want


def test_throttle_doubles_its_pauses():
    m = state.Throttle(quota=4, window=100.0, pause=1.0, longest=3.0)
    s = m.start()
    call = lambda t, ok: m.step(s, t, type("Row", (), {"ok": ok}))
    assert call(0, False) == (True, 0.0) and call(0.5, True) == (False, 0.5)
    assert call(1, False) == (True, 0.0) and call(2, True) == (False, 1.0)
    assert call(3, False) == (True, 0.0) and call(5.5, True) == (False, 0.5)  # four seconds are held to three
    assert call(6, True) == (True, 0.0) and s["failures"] == 0
    assert call(7, True) == (False, 93.0) and call(100, True) == (True, 0.0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_error_rates_and_ratios(spark):
    items = {r["item_id"]: r["text"] or "" for r in rows("benchmark")}
    want = {i: round(edits(t.split(), t.replace("th", "t").split()) / max(len(t.split()), 1), 6) for i, t in items.items()}
    assert {r.item_id: r.wer for r in QUERIES["word_error_rate"](spark, DATA).collect()} == want
    ratio = {i: round(difflib.SequenceMatcher(None, t, t.lower()).ratio(), 6) for i, t in items.items()}
    assert {r.item_id: r.ratio for r in QUERIES["seq_ratio"](spark, DATA).collect()} == ratio


def test_confusions_are_the_letters_left_out(spark):
    want = Counter()
    for r in rows("benchmark"):
        want["h", ""] += (r["text"] or "").count("th")
    got = {(r.wanted, r.got): r.n for r in QUERIES["confusion_matrix"](spark, DATA).collect()}
    assert sum(got.values()) >= sum(want.values()) and got["h", ""] == want["h", ""]


def test_splits_have_exact_sizes_and_do_not_move(spark):
    first = {r.doc_id: r.split for r in QUERIES["split_hash"](spark, DATA).collect()}
    n = len(first)
    assert Counter(first.values()) == {"train": int(n * 0.8), "val": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    assert {r.doc_id: r.split for r in QUERIES["split_hash"](spark, DATA).collect()} == first


def test_diversity_is_greedy(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in rows("embeddings")}
    chosen = [min(vectors)]
    while len(chosen) < 6:
        far = lambda k: min(sum((a - b) ** 2 for a, b in zip(vectors[k], vectors[c], strict=True)) ** 0.5 for c in chosen)
        chosen.append(max(vectors, key=lambda k: (round(far(k), 9), -k)))
    got = sorted((r.step, r.vec_id) for r in QUERIES["diversity_sample"](spark, DATA).collect())
    assert [k for _, k in got] == chosen


def test_clusters_by_hand(spark):
    found = {r.component: r for r in QUERIES["cluster_merge"](spark, DATA).collect()}
    named = {r.node: r.component for r in QUERIES["dedup_components"](spark, DATA).collect()}
    members = defaultdict(list)
    for node, c in named.items():
        members[c].append(node)
    assert {c: r.n for c, r in found.items()} == {c: len(m) for c, m in members.items()}
    for c, m in members.items():
        assert found[c].representative == max(m, key=lambda k: (len(str(k)), -k)) and 0.42 <= found[c].score <= 1.0001


def test_engines_and_learning_rounds(spark):
    engines = E.Engines().register("upper", lambda df: df.withColumns({"text": F.upper("t"), "confidence": F.lit(0.9)})).register("same", lambda df: df.withColumns({"text": F.col("t"), "confidence": F.lit(0.5)}))
    with pytest.raises(ValueError):
        engines.register("same", lambda df: df)
    df = spark.createDataFrame([(i, f"w{i}") for i in range(6)], "id int, t string")
    assert sorted((r.engine, r.text) for r in engines.outputs(df).where("id = 1").collect()) == [("same", "w1"), ("upper", "W1")]
    best = L.best_confidence(engines.outputs(df), "id", "engine", "text", "confidence").collect()
    assert {r.text for r in best} == {f"W{i}" for i in range(6)}
    learned = E.learning_rounds(df, "id", lambda pool: pool.orderBy("id").limit(2), lambda some: some.withColumn("label", F.concat("t", F.lit("!"))), 2)
    assert sorted((r.id, r.label, r.round) for r in learned.collect()) == [(0, "w0!", 0), (1, "w1!", 0), (2, "w2!", 1), (3, "w3!", 1)]


def test_dictionary_beyond_the_broadcast_bound(spark):
    from lexforge.operators.correct import apply_dictionary
    from lexforge.operators.dedup import shared_grams

    docs = spark.createDataFrame([(1, "The old Gear  is\tnew"), (2, ""), (3, None), (4, "gear gear")], "id int, text string")
    fixes = spark.createDataFrame([("gear", "wheel"), ("OLD", "young"), ("gear", "zahnrad")], "word string, correction string")
    for most in (10, 0):
        got = {r.id: (r.corrected, r.n_fixed) for r in apply_dictionary(docs, fixes, "id", "text", most).collect()}
        assert got == {1: ("The young wheel is new", 2), 4: ("wheel wheel", 2)}
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "x A B c")], "k int, text string")
    items = spark.createDataFrame([(7, "z a b c d"), (8, "q")], "item int, text string")
    for most in (10, 0):
        assert sorted(tuple(r) for r in shared_grams(texts, items, "k", "item", "text", 3, most).collect()) == [(1, 7, 2), (2, 7, 1)]


def test_near_copies_by_hand(spark):
    import random

    from lexforge.operators.dedup import shingle_links

    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(60)] for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "one two", texts[0]]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in enumerate(texts) if (w := (t or "").split())}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.a, r.b) for r in shingle_links(df, "id", "text").collect()}
    low = {}
    for i in sorted(sets):
        low.setdefault(frozenset(sets[i]), i)
    links = {(i, j) for i, j in want if low[frozenset(sets[i])] == i and (low[frozenset(sets[j])] == j or low[frozenset(sets[j])] == i)}
    assert got == links
