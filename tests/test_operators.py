"""Operators on small frames with known answers."""

import difflib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexforge.functions import detect as D
from lexforge.functions import normalize as N
from lexforge.functions import similarity as M
from lexforge.operators import curate as C
from lexforge.operators import dedup as U
from lexforge.operators import export as X
from lexforge.operators import layout as Y
from lexforge.operators import learn as L
from lexforge.operators import relational as R
from lexforge.operators import search as S
from lexforge.streaming import state


def one(spark, column, text=""):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_boolean_queries():
    assert S.parse_boolean("a OR b") == {"must": [], "any": ["a", "b"], "none": []}
    assert S.parse_boolean('x AND "y z" NOT w') == {"must": ["x", "y z"], "any": [], "none": ["w"]}
    assert S.parse_boolean("a b") == {"must": ["a", "b"], "any": [], "none": []}
    assert S.parse_boolean("") == {"must": [], "any": [], "none": []}


def test_like_wildcards_are_literal(spark):
    df = spark.createDataFrame([("100%",), ("1000",)], "t string")
    assert df.where(R.contains_any(df, "100%", ["t"])).count() == 1
    with pytest.raises(ValueError):
        R.contains_any(df, "x", ["missing; drop"])


def test_error_rates_and_grades(spark):
    rows = spark.createDataFrame([("cat", "bat"), ("", ""), ("", "a"), ("same", "same")], "a string, b string")
    assert [r.x for r in rows.select(F.round(M.cer(F.col("a"), F.col("b")), 4).alias("x")).collect()] == [0.3333, 0.0, 1.0, 0.0]
    words = spark.createDataFrame([("a b c d", "a x c"), ("", "")], "a string, b string")
    assert [r.x for r in words.select(M.wer(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 0.0]
    assert [one(spark, M.grade(F.lit(v))) for v in (0.02, 0.05, 0.0999, 0.1, 0.4, 0.41)] == ["A+", "A", "B", "C", "D", "F"]
    assert M.align("abc", "ac") == [("a", "a"), ("b", ""), ("c", "c")]


def test_sequence_ratio(spark):
    row = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(M.sequence_ratio("a", "b").alias("r")).first()
    assert row.r == pytest.approx(difflib.SequenceMatcher(None, "abcd", "bcde").ratio())


def test_boxes(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 5.0, 10.0, 10.0), (1, 3, 90.0, 90.0, 1.0, 1.0)], "page int, id int, x double, y double, w double, h double")
    got = Y.overlapping(df, ["page"], "id", 0.05).collect()
    assert [(r.id_a, r.id_b, round(r.iou, 4)) for r in got] == [(1, 2, round(25 / 175, 4))]


def test_rows_by_anchor_and_mean(spark):
    ys = F.array(*map(F.lit, [0.0, 9.0, 11.0, 19.0, 30.0]))
    assert one(spark, Y.anchored_rows(ys, 10.0)) == [[0.0, 9.0], [11.0, 19.0], [30.0]]
    assert one(spark, Y.mean_rows(ys, 10.0)) == [[0.0, 9.0, 11.0], [19.0], [30.0]]


def test_protect_and_restore(spark):
    p = N.protected(F.col("t"), ["aspirin", "aspirin forte"])
    got = spark.createDataFrame([("take Aspirin forte or aspirin",)], "t string").select(p.alias("p")).select("p.text", "p.found", N.restored(F.col("p.text"), F.col("p.found")).alias("back")).first()
    assert got.text == "take __MED_0__ or __MED_1__" and got.back == "take Aspirin forte or aspirin"


def test_text_helpers(spark):
    assert one(spark, N.roman_value(F.lit("XIV"))) == 14 and one(spark, N.roman_value(F.lit("IIII"))) is None
    assert one(spark, N.repaired_digits(F.lit("l0O oil S5 x"))) == "100 oil 55 x"
    assert one(spark, N.repaired_units(F.lit("5 m g and 3 k P a"))) == "5 mg and 3 kPa"
    assert one(spark, N.safe_filename(F.lit("../../etc/pass:wd"))) == "pass_wd"
    assert [r.kind for r in one(spark, N.list_items(F.lit("• one\n2. two\ntext\n\n")))] == ["list_item", "list_item", "paragraph"]
    assert [r.lang for r in one(spark, N.language_runs(F.lit("hello world كسر العظم 12")))] == ["en", "ar", "other"]
    assert one(spark, N.chunks(F.lit(""))) == []
    assert one(spark, N.translation_corrected(F.lit("كلمة ,كلمة  1 2")).text) is not None


def test_medical_rules(spark):
    text = "Warfarin 5mg daily + Aspirin 1000mg daily. Right knee. Left and right hand."
    assert one(spark, D.interactions(F.lit(text))) == ["aspirin+warfarin"]
    assert [(i.drug, i.level) for i in one(spark, D.dose_issues(F.lit(text)))] == [("aspirin", "ERROR")]
    assert one(spark, D.laterality_conflicts(F.lit(text))) == 1
    assert one(spark, D.merge_conflicts(F.lit("right wrist"), F.lit("left wrist"))) == ["laterality"]
    assert one(spark, D.merge_conflicts(F.lit("wrist"), F.lit("left wrist"))) == []


def test_pii_rules(spark):
    assert one(spark, D.risk(F.lit("clean text"))) == "none"
    assert one(spark, D.risk(F.lit("-----BEGIN PRIVATE KEY-----"))) == "critical"
    assert one(spark, D.anonymised(F.lit("mail a@b.co now"))) == "mail [REDACTED] now"
    assert D.with_pattern([], "X", "low", "x+") == [("X", "low", "x+")]
    with pytest.raises(ValueError):
        D.with_pattern([], "X", "odd", "x")


def test_upserts_and_deletes(spark):
    have = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y")], "k string, frequency int, v string")
    new = spark.createDataFrame([("a", "z"), ("c", "w"), ("c", "w")], "k string, v string")
    got = {r.k: (r.frequency, r.v) for r in R.upsert_counts(have, new, ["k"]).collect()}
    assert got == {"a": (3, "z"), "b": (1, "y"), "c": (2, "w")}
    rest, (child,) = R.delete_where(have, F.col("frequency") > 1, [(new, ["k"])])
    assert [r.k for r in rest.collect()] == ["b"] and {r.k for r in child.collect()} == {"c"}
    kept = R.insert_or_ignore(have.select("k", "v"), new, ["k"], [F.col("v")])
    assert sorted((r.k, r.v) for r in kept.collect()) == [("a", "x"), ("b", "y"), ("c", "w")]
    assert {r.k: r.v for r in R.update_by_key(have, new.where("k = 'a'"), ["k"], ["v"]).collect()}["a"] == "z"


def test_lineage(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("d", "c")], "v string, parent string")
    got = {(r.child, r.ancestor): r.distance for r in R.lineage(edges, "v", "parent").collect()}
    assert got[("d", "a")] == 3 and len(got) == 6


def test_roles():
    assert R.infer_roles(["English text", "Arabic text"]) == {"source": "English text", "target": "Arabic text"}
    assert R.infer_roles(["x1", "x2"]) == {"source": "x1", "target": "x2"}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in U.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_limiter_and_breaker():
    limiter = state.RateLimiter(limit=1, burst=1, window=60, violations=2, penalty=100)
    s = limiter.start()
    assert [limiter.step(s, t, None)[0] for t in (0, 1, 2, 3, 50, 104)] == [True, True, False, False, False, True]
    breaker = state.CircuitBreaker(failures=2, recovery=10, successes=1)
    s, ok, bad = breaker.start(), Row(ok=True), Row(ok=False)
    assert [breaker.step(s, t, e)[0] for t, e in ((0, bad), (1, bad), (2, ok), (12, ok), (13, ok))] == ["closed", "open", "open", "closed", "closed"]


def test_fold_equals_stream(spark, tmp_path):
    rows = [("a", i, float(i * 20), True) for i in range(8)] + [("b", 100 + i, float(i), True) for i in range(5)]
    events = spark.createDataFrame(rows, "key string, id long, t double, ok boolean")
    machine = state.RateLimiter(limit=2, burst=0, window=60, violations=5)
    want = sorted(tuple(r) for r in state.fold(events, machine).collect())
    events.write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).json(str(tmp_path / "in"))
    query = state.stream(source, machine, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_splits_have_exact_sizes(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    got = {r.split: r["count"] for r in C.hash_split(df, "k", 0.8, 0.1, 7).groupBy("split").count().collect()}
    assert got == {"train": 82, "val": 10, "test": 11}
    assert C.hybrid_sample(df.withColumn("c", F.rand(1)), "k", "c", 10, 0.5).distinct().count() == 10


def test_validation_and_versions(spark):
    v = C.validated(F.lit("abc"), F.lit("abd"), rules={"no_x": F.lit(False)})
    got = one(spark, v)
    assert got.score == pytest.approx(0.9) and not got.is_valid
    assert one(spark, C.version_key(F.lit("1.10.2")) > C.version_key(F.lit("1.9.9")))
    assert one(spark, C.accepts(F.lit(0.0), F.lit(0.04)))


def test_farthest_points(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0]), (3, [5.0])], "k long, v array<double>")
    assert [r.k for r in L.farthest_points(df, "k", "v", 3).orderBy("step").collect()] == [0, 2, 3]


def test_encryption_round_trip(spark):
    key = F.lit("0123456789abcdef")
    assert one(spark, X.decrypted(X.encrypted(F.lit("secret"), key), key)) == "secret"


def test_shingle_links_of_copies(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(0, words), (1, words), (2, words + " tail"), (3, "other text altogether here now"), (4, ""), (5, None)]
    got = {(r.a, r.b) for r in U.shingle_links(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {(0, 1), (0, 2)}


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_texts_without_a_partner_give_up_few_shingles(spark, monkeypatch, threshold):
    """Only texts that share enough of their least hashes are compared, and no link is lost."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    line, texts = some(12), []
    for n in [1, 3, 4, 5, 6, 9, 40, 80, 150]:
        base = some(n) + (line if n > 30 else [])
        texts += [base, base, *([w if rng.random() > p else "x" for w in base] for p in (0.01, 0.03, 0.08))]
    texts += [some(60) + line for _ in range(60)]  # one line in common
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n")]
    written, tables = U.written, []
    monkeypatch.setattr(U, "written", lambda df: tables.append(written(df)) or tables[-1])
    got = {(r.a, r.b): round(r.similarity, 9) for r in U.shingle_links(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t", threshold).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in first.values() for b in first.values() if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    want |= {(first[frozenset(s)], i): 1.0 for i, s in enumerate(sets) if first[frozenset(s)] != i}
    assert got == want and len(want) > 15
    assert tables[-1].count() < len(first) - (40 if threshold == 0.8 else 5)
