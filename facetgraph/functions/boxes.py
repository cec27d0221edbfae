"""Boxes x, y, w, h as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def suppressed(boxes: Column, overlap: float = 0.4) -> Column:
    """Non-maximum suppression of an array of (conf, i, x, y, w, h), as one fold of a row.

    Boxes are taken by falling confidence (then by i) and kept where none kept before
    overlaps them by more than overlap.
    """
    ordered = F.sort_array(F.transform(boxes, lambda b: F.struct((-b["conf"]).alias("k"), b["i"].alias("i"), b["conf"].alias("conf"), *[b[c].cast("double").alias(c) for c in "xywh"])))
    start = F.filter(ordered, lambda b: F.lit(False))
    return F.aggregate(ordered, start, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > overlap), kept).otherwise(F.concat(kept, F.array(b))))


def anchor_box(cx: Column, cy: Column, deltas: Column, stride: float, scale: Column) -> Column:
    """A box from the distances left, up, right, down of an anchor's centre, in the picture's own pixels."""
    left, up, right, down = (deltas[k].cast("double") * stride for k in range(4))
    x, y = (cx - left) / scale, (cy - up) / scale
    return F.struct(x.alias("x"), y.alias("y"), ((cx + right) / scale - x).alias("w"), ((cy + down) / scale - y).alias("h"))


def anchor_points(cx: Column, cy: Column, offsets: Column, stride: float, scale: Column) -> Column:
    """Key points from their offsets (x, y, x, y, ...) to an anchor's centre."""
    n = F.floor(F.size(offsets) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(((cx + offsets[2 * k] * stride) / scale).alias("x"), ((cy + offsets[2 * k + 1] * stride) / scale).alias("y")))
