"""Values found next to or between anchor texts, as column expressions over a document's boxes.

Rules are data: one generic expression is evaluated for each rule of a document's template, so plans do not grow
with the number of rules and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import geometry as g
from docfields.functions.binding import let


def placed(boxes: Column) -> Column:
    """Boxes with their index and centre: array<struct<idx, text, confidence, points, x, y>>."""

    def one(b: Column, i: Column) -> Column:
        c = g.centre(b["points"])
        return F.struct(i.alias("idx"), b["text"].alias("text"), b["confidence"].alias("confidence"), b["points"].alias("points"), c["x"].alias("x"), c["y"].alias("y"))

    return F.transform(boxes, one)


def _holds(b: Column, anchors: Column) -> Column:
    return F.coalesce(F.exists(anchors, lambda a: F.contains(b["text"], a)), F.lit(False))


def anchor(boxes: Column, anchors: Column) -> Column:
    """The first box in box order that holds any anchor; null where none does.  ``boxes`` are ``placed``."""
    return F.get(F.filter(boxes, lambda b: _holds(b, anchors)), F.lit(0))


def _nearest(boxes: Column, a: Column, ahead, furthest: Column) -> Column:
    """The nearest other box that lies ahead of ``a``, of equally near ones the first."""
    far = lambda b: g.distance(a["x"], a["y"], b["x"], b["y"])
    met = F.filter(boxes, lambda b: (b["idx"] != a["idx"]) & ahead(b))
    ranked = F.transform(met, lambda b: F.struct(far(b).alias("d"), b["idx"].alias("idx")))
    return let(F.array_min(ranked), lambda best: F.when(best["d"] <= g.f32(furthest), F.get(boxes, best["idx"])))


def right(boxes: Column, a: Column, tolerance: Column, furthest: Column) -> Column:
    return _nearest(boxes, a, lambda b: g.same_line(a["y"], b["y"], tolerance) & (b["x"] > a["x"]), furthest)


def beneath(boxes: Column, a: Column, furthest: Column) -> Column:
    return _nearest(boxes, a, lambda b: b["y"] > a["y"], furthest)


def _field(value: Column, confidence: Column, points: Column, method: str) -> Column:
    return F.struct(
        value.alias("value"), value.alias("raw_value"), confidence.alias("confidence"), points.alias("source_bbox"),
        F.lit(method).alias("extraction_method"), F.lit("not_validated").alias("validation_status"),
    )


def _by_anchor(boxes: Column, rule: Column, a: Column, down: bool) -> Column:
    def judged(found: Column) -> Column:
        # The region judges the nearest box; a farther one inside it does not step in.
        fits = found.isNotNull() & g.in_region(found["x"], found["y"], rule["region"])
        return F.when(fits, _field(found["text"], found["confidence"], found["points"], "anchor_below" if down else "anchor_right"))

    return let(beneath(boxes, a, rule["max_distance"]) if down else right(boxes, a, rule["same_line_tolerance"], rule["max_distance"]), judged)


def by_anchor(boxes: Column, rule: Column) -> Column:
    """Field beside the anchor: below it where the rule's direction says so, else right of it; where nothing is there
    and the rule's kind names a way, the other way is tried.  Null where neither finds one."""
    down = rule["search_direction"] == "below"

    def ways(a: Column) -> Column:
        # The other way is worked out only if the first finds nothing and the kind calls for it.
        to_right, to_below = _by_anchor(boxes, rule, a, False), _by_anchor(boxes, rule, a, True)
        kind = rule["extraction_type"]
        return F.when(down, F.coalesce(to_below, F.when(kind == "anchor_below", to_right))).otherwise(F.coalesce(to_right, F.when(kind == "anchor_right", to_below)))

    return let(anchor(boxes, rule["anchors"]), lambda a: F.when(a.isNotNull(), ways(a)))


def between(boxes: Column, start: Column, end: Column) -> Column:
    """Boxes with centres strictly between two boxes, top down, of equally high ones the first."""
    inside = F.filter(boxes, lambda b: (b["idx"] != start["idx"]) & (b["idx"] != end["idx"]) & (b["y"] > start["y"]) & (b["y"] < end["y"]))
    return F.transform(F.array_sort(F.transform(inside, lambda b: F.struct(b["y"].alias("y"), b["idx"].alias("idx")))), lambda k: F.get(boxes, k["idx"]))


def end_anchor(boxes: Column, start: Column, anchors: Column) -> Column:
    """The highest box below the start that holds an end anchor; of equally high ones by anchor, then box."""

    def candidates(a: Column, order: Column) -> Column:
        held = F.filter(boxes, lambda b: F.contains(b["text"], a) & (b["y"] > start["y"]))
        return F.transform(held, lambda b: F.struct(b["y"].alias("y"), order.alias("order"), b["idx"].alias("idx")))

    best = F.array_min(F.flatten(F.transform(anchors, candidates)))
    return F.get(boxes, best["idx"])


def mean_confidence(boxes: Column) -> Column:
    """Mean in 32-bit floats, summed in order."""
    total = F.aggregate(boxes, F.lit(0.0).cast("float"), lambda acc, b: g.f32(acc + b["confidence"]))
    return g.f32(total / F.size(boxes))


def paragraph(boxes: Column, rule: Column) -> Column:
    """Field of all text between a start and an end anchor; null where either is missing or nothing lies between."""

    def told(start: Column, inside: Column) -> Column:
        text = F.array_join(F.transform(inside, lambda b: b["text"]), "\n")
        return F.when(F.size(inside) > 0, _field(text, mean_confidence(inside), start["points"], "paragraph_between_anchors"))

    def spanned(start: Column, end: Column) -> Column:
        return F.when(end.isNotNull(), let(between(boxes, start, end), lambda inside: told(start, inside)))

    def begun(start: Column) -> Column:
        return F.when(start.isNotNull(), let(end_anchor(boxes, start, rule["end_anchors"]), lambda end: spanned(start, end)))

    return let(anchor(boxes, rule["start_anchors"]), begun)


def extracted(boxes: Column, rule: Column) -> Column:
    """Field of a rule; null where nothing is found."""
    return F.when(rule["extraction_type"] == "paragraph_between_anchors", paragraph(boxes, rule)).otherwise(by_anchor(boxes, rule))
