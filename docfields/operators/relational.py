"""The box searches as joins, one row a box: for pages with very many boxes, and to test the column forms.

Boxes are rows (doc_id, box_idx, text, x, y); every result has at most one row a document (or document and anchor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import geometry as g


def exploded(docs: DataFrame) -> DataFrame:
    """One row a box of (doc_id, boxes)."""
    rows = docs.select("doc_id", F.posexplode("boxes").alias("box_idx", "b"))
    c = g.centre(F.col("b.points"))
    return rows.select("doc_id", "box_idx", "b.text", "b.confidence", c["x"].alias("x"), c["y"].alias("y"))


def anchors(boxes: DataFrame, words: list[str]) -> DataFrame:
    """First box of each document that holds any of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains("text", F.lit(w))
    return boxes.where(hit).groupBy("doc_id").agg(F.min_by(F.struct("box_idx", "x", "y"), F.col("box_idx")).alias("a")).select("doc_id", F.col("a.box_idx").alias("a_idx"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"))


def _nearest(boxes: DataFrame, found: DataFrame, ahead: Column, furthest: float) -> DataFrame:
    far = g.distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y"))
    pairs = boxes.join(found, "doc_id").where("box_idx <> a_idx").where(ahead).withColumn("distance", far)
    best = pairs.where(F.col("distance") <= F.lit(furthest).cast("float")).groupBy("doc_id", "a_idx")
    return best.agg(F.min_by(F.struct("box_idx", "text", "distance"), F.struct("distance", "box_idx")).alias("v")).select("doc_id", "a_idx", "v.*")


def nearest_right(boxes: DataFrame, found: DataFrame, tolerance: float, furthest: float) -> DataFrame:
    """doc_id, a_idx, box_idx, text, distance: the nearest box right of each anchor (doc_id, a_idx, ax, ay)."""
    return _nearest(boxes, found, g.same_line(F.col("ay"), F.col("y"), F.lit(tolerance)) & (F.col("x") > F.col("ax")), furthest)


def nearest_below(boxes: DataFrame, found: DataFrame, furthest: float) -> DataFrame:
    return _nearest(boxes, found, F.col("y") > F.col("ay"), furthest)


def between(boxes: DataFrame, start: list[str], end: list[str]) -> DataFrame:
    """doc_id, value, confidence: text between a start anchor and the highest end anchor below it."""
    first = anchors(boxes, start)
    order = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(end))):
        order = F.when(F.contains("text", F.lit(w)), F.lit(i)).otherwise(order)
    ends = boxes.withColumn("o", order).where("o is not null").join(first, "doc_id").where("y > ay").groupBy("doc_id", "a_idx", "ay")
    ends = ends.agg(F.min_by(F.struct("box_idx", "y"), F.struct("y", "o", "box_idx")).alias("e"))
    inside = boxes.join(ends, "doc_id").where("box_idx <> a_idx and box_idx <> e.box_idx and y > ay and y < e.y")
    rows = F.array_sort(F.collect_list(F.struct("y", "box_idx", "text", "confidence")))
    out = inside.groupBy("doc_id").agg(rows.alias("r"))
    total = F.aggregate("r", F.lit(0.0).cast("float"), lambda acc, b: g.f32(acc + b["confidence"]))
    return out.select("doc_id", F.array_join(F.transform("r", lambda b: b["text"]), "\n").alias("value"), g.f32(total / F.size("r")).alias("confidence"))
