"""Spatial operators on pages: lines, rows, reading order, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_lines(df: DataFrame, page: list[str], y: str, ties: list[str], tolerance: float) -> DataFrame:
    """df with line: a new line starts where y grows by more than tolerance over the row before."""
    order = Window.partitionBy(*page).orderBy(y, *ties)
    jump = F.when(F.col(y) - F.lag(y).over(order) > tolerance, 1).otherwise(0)
    return df.withColumn("__jump", jump).withColumn("line", F.sum("__jump").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__jump")


def anchored_rows(ys: Column, tolerance: float) -> Column:
    """array<array<double>> of sorted ys: a value at tolerance or more from a row's first starts a row."""
    start = F.array().cast("array<array<double>>")

    def step(rows: Column, y: Column) -> Column:
        last = F.element_at(rows, -1)
        joins = (F.size(rows) > 0) & (F.abs(y - F.get(last, F.lit(0))) < tolerance)
        kept = F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(F.concat(last, F.array(y))))).otherwise(F.concat(rows, F.array(F.array(y))))

    return F.aggregate(ys.cast("array<double>"), start, lambda rows, y: F.when(F.size(rows) == 0, F.array(F.array(y))).otherwise(step(rows, y)))


def mean_rows(ys: Column, tolerance: float) -> Column:
    """As anchored_rows, with the row's running mean as what values are compared with."""
    start = F.array().cast("array<array<double>>")

    def step(rows: Column, y: Column) -> Column:
        last = F.element_at(rows, -1)
        mean = F.aggregate(last, F.lit(0.0), lambda a, b: a + b) / F.size(last)
        kept = F.slice(rows, 1, F.size(rows) - 1)
        return F.when(F.abs(y - mean) < tolerance, F.concat(kept, F.array(F.concat(last, F.array(y))))).otherwise(F.concat(rows, F.array(F.array(y))))

    return F.aggregate(ys.cast("array<double>"), start, lambda rows, y: F.when(F.size(rows) == 0, F.array(F.array(y))).otherwise(step(rows, y)))


def ordered_text(words: Column, rtl: Column) -> Column:
    """Texts of array<struct<x,text>> joined by spaces, right to left where rtl."""
    keyed = F.array_sort(F.transform(words, lambda w: F.struct(F.when(rtl, -w.x).otherwise(w.x).alias("k"), w.text.alias("text"))))
    return F.array_join(F.transform(keyed, lambda w: w.text), " ")


def intersection(a, b) -> Column:
    """Area shared by two boxes with x, y, w, h."""
    ix = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    iy = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    return ix * iy


def iou(a, b) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    shared = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def contains(a, b) -> Column:
    """Box a holds box b."""
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def overlapping(boxes: DataFrame, page: list[str], key: str, least: float) -> DataFrame:
    """Pairs (id_a < id_b) of boxes of a page whose IoU is over least. Pages are small by nature."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page]
    near = (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w")) & (F.col("a.y") < F.col("b.y") + F.col("b.h")) & (F.col("b.y") < F.col("a.y") + F.col("a.h"))
    both = a.join(b, [*on, F.col(f"a.{key}") < F.col(f"b.{key}"), near])
    side = lambda s: {c: F.col(f"{s}.{c}") for c in "xywh"}
    return both.select(*(F.col(f"a.{p}") for p in page), F.col(f"a.{key}").alias("id_a"), F.col(f"b.{key}").alias("id_b"), iou(side("a"), side("b")).alias("iou")).where(F.col("iou") > least)
