from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexforge.operators import curate, extend, medical, review


def test_failing_rows_are_null(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    assert [r.n for r in extend.map_rows(df, "t", int, "n", "long").collect()] == [1, None, None]


def test_steps_run_in_order_and_again():
    seen = []

    def shaky(x):
        seen.append(x)
        if len(seen) < 2:
            raise OSError("once")
        return x + 1

    steps = extend.Steps().add("b", shaky, ("a",), retries=1).add("a", lambda: 1)
    assert steps.order() == ["a", "b"] and steps.run() == {"a": 1, "b": 2} and seen == [1, 1]
    with pytest.raises(ValueError):
        extend.Steps().add("a", lambda: 1, ("b",)).add("b", lambda: 1, ("a",)).order()


def test_rules_and_time(spark):
    rules = extend.Rules().add("longer", lambda a, b: F.char_length(b) > F.char_length(a))
    row = spark.createDataFrame([("ab", "a", "2024-01-01", "bad")], "a string, b string, t string, u string")
    got = row.select(curate.validated(F.col("a"), F.col("b"), rules=rules.columns(F.col("a"), F.col("b"))).alias("v"), extend.clock(F.lit(125.7)).alias("c"), extend.age_days(F.col("t"), F.to_date(F.lit("2024-01-11"))).alias("d"), extend.age_days(F.col("u"), F.to_date(F.lit("2024-01-11"))).alias("e")).first()
    assert got.v.score == pytest.approx(0.9) and (got.c, got.d, got.e) == ("02:05", 10, 999)
    assert extend.next_run("03:30", datetime(2024, 1, 1, 4)) == datetime(2024, 1, 2, 3, 30)


def test_accounts_and_models(spark):
    accounts = spark.createDataFrame([(1, 5, None, 1.0, True), (2, 9, 10, 2.0, True), (3, 99, 1, 1.0, False)], "id int, priority int, last_used int, weight double, active boolean")
    pick = lambda s, t=0: review.next_account(accounts, s, t).first().id
    assert pick("priority") == 2 and pick("lru") == 1 and [pick("round_robin", t) for t in range(3)] == [1, 2, 1] and pick("weighted", 7) in (1, 2)


def test_line_fusion(spark):
    rows = spark.createDataFrame([(1, "surya", "abc", 0.8), (1, "trocr", "abd", 0.81), (1, "easyocr", "abc", 0.7)], "line int, engine string, text string, confidence double")
    pick = lambda s: review.fused_lines(rows, "line", s, {"surya": 0.95, "trocr": 0.8}).first()
    assert pick("voting").text == "abc" and pick("highest_confidence").text == "abc" and pick("weighted_average").confidence == pytest.approx((0.8 * 0.95 + 0.81 * 0.8 + 0.7 * 0.8) / 2.55)


def test_entries_and_spelling(spark):
    row = spark.createDataFrame([("femur عظم", "a bone [Anatomy]", "hipertension and diabetes")], "a string, b string, c string")
    got = row.select(medical.dictionary_entry(F.col("a"), F.col("b")).alias("e"), medical.misspellings(F.col("c")).alias("m"), medical.term_confidence(F.lit("bone"), F.lit("عظم")).alias("t")).first()
    assert (got.e.term_en, got.e.term_ar, got.e.category) == ("femur", "عظم", "anatomy") and got.m == ["hipertension"] and got.t == pytest.approx(0.9)
