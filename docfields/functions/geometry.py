"""Box geometry in 32-bit floats.  Every function takes and gives columns; points are arrays of struct<x,y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = 1000


def f32(c: Column) -> Column:
    return c.cast("float")


def centre(points: Column) -> Column:
    """struct<x,y>: the mean of the four corners, summed in order; (0, 0) where there are not four."""

    def mean(axis: str) -> Column:
        total = F.lit(0.0).cast("float")
        for i in range(4):
            total = total + F.get(points, F.lit(i))[axis]
        return F.coalesce(f32(total / 4), F.lit(0.0).cast("float"))

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def bounds(points: Column) -> Column:
    """struct<x_min,y_min,x_max,y_max>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of two centres; a square root in double rounds to the right float."""
    dx, dy = f32(ax - bx), f32(ay - by)
    return f32(F.sqrt(f32(f32(dx * dx) + f32(dy * dy)).cast("double")))


def same_line(ay: Column, by: Column, tolerance: Column) -> Column:
    return F.abs(f32(ay - by)) <= f32(tolerance)


def right_of(a: Column, b: Column, tolerance: Column) -> Column:
    """b begins right of the end of a; a and b are ``bounds``."""
    return b["x_min"] >= f32(a["x_max"] - f32(tolerance))


def below(a: Column, b: Column, tolerance: Column) -> Column:
    return b["y_min"] >= f32(a["y_max"] - f32(tolerance))


def in_region(x: Column, y: Column, region: Column) -> Column:
    """Centre within the inclusive [x1, y1, x2, y2]; a region that has not four numbers holds everything."""
    at = lambda i: f32(F.get(region, F.lit(i)))
    inside = (x >= at(0)) & (x <= at(2)) & (y >= at(1)) & (y <= at(3))
    return F.when(F.coalesce(F.size(region), F.lit(0)) == 4, inside).otherwise(F.lit(True))


def normalised(boxes: Column, width: Column, height: Column, target: int = NORMAL) -> Column:
    """Boxes scaled to ``target`` on both axes; unchanged where a side of the image is not positive."""
    sx, sy = (f32(f32(F.lit(target)) / f32(side)) for side in (width, height))
    scaled = F.transform(
        boxes,
        lambda b: b.withField("points", F.transform(b["points"], lambda p: F.struct(f32(p["x"] * sx).alias("x"), f32(p["y"] * sy).alias("y")))),
    )
    return F.when((width > 0) & (height > 0), scaled).otherwise(boxes)


def text_of(boxes: Column) -> Column:
    """All texts in box order, one a line."""
    return F.array_join(F.transform(boxes, lambda b: b["text"]), "\n")


def confident(boxes: Column, least: float) -> Column:
    return F.filter(boxes, lambda b: b["confidence"] >= F.lit(least).cast("float"))


def ordered_corners(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: by y, then each pair by x."""
    key = lambda first, second: lambda p: F.struct(p[first].alias("k"), p[second].alias("l"))
    by_y = F.array_sort(F.transform(points, lambda p: F.struct(key("y", "x")(p).alias("key"), p.alias("p"))))
    pair = lambda a, b: F.array_sort(F.transform(F.slice(by_y, a, b), lambda s: F.struct(key("x", "y")(s["p"]).alias("key"), s["p"].alias("p"))))
    top, bottom = pair(1, 2), pair(3, 2)
    at = lambda a, i: F.get(a, F.lit(i))["p"]
    return F.array(at(top, 0), at(top, 1), at(bottom, 1), at(bottom, 0))


def page_type(ratio: Column) -> Column:
    """``A4`` where the short side is within 15 % of 1/sqrt(2) of the long one, else ``unknown``."""
    folded = F.when(ratio > 1, 1 / ratio).otherwise(ratio)
    a4 = F.lit(1.0) / F.sqrt(F.lit(2.0))
    return F.when((ratio > 0) & (F.abs(folded - a4) / a4 <= 0.15), F.lit("A4")).otherwise(F.lit("unknown"))


def _span(a: Column, b: Column) -> Column:
    dx, dy = (a["x"] - b["x"]).cast("double"), (a["y"] - b["y"]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def quad_measures(corners: Column, total_area: Column) -> Column:
    """struct<area, aspect_ratio, confidence, left, top, width, height> of ordered corners."""
    p = [F.get(corners, F.lit(i)) for i in range(4)]
    cross = F.lit(0.0)
    for i in range(4):
        a, b = p[i], p[(i + 1) % 4]
        cross = cross + (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")
    area = F.abs(cross) / 2
    wide, tall = (_span(p[0], p[1]) + _span(p[3], p[2])) / 2, (_span(p[0], p[3]) + _span(p[1], p[2])) / 2
    box = bounds(corners)
    return F.struct(
        area.alias("area"),
        F.when(tall > 0, wide / tall).otherwise(F.lit(0.0)).alias("aspect_ratio"),
        f32(F.least(F.lit(1.0), area / total_area)).alias("confidence"),
        box["x_min"].cast("int").alias("left"),
        box["y_min"].cast("int").alias("top"),
        (box["x_max"] - box["x_min"]).cast("int").alias("width"),
        (box["y_max"] - box["y_min"]).cast("int").alias("height"),
    )
