"""Rectangle and keypoint geometry as Column expressions.

A box is four columns (x1, y1, x2, y2); areas are half-open, so a box of equal edges is empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """The edges of a rectangle."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """The box in the columns ``<prefix>x1`` to ``<prefix>y2``."""
    return Box(*(F.col(f"{prefix}{e}") for e in ("x1", "y1", "x2", "y2")))


def box_of(array: str | Column) -> Box:
    """The box in an array of four; a null or wrong-sized array gives null edges."""
    a = F.col(array) if isinstance(array, str) else array
    return Box(*(F.when(F.size(a) == 4, F.get(a, F.lit(i))) for i in range(4)))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), width(b)) * F.greatest(F.lit(0), height(b))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def overlap_area(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for missing boxes and empty unions."""
    shared = overlap_area(a, b)
    union = area(a) + area(b) - shared
    return F.coalesce(F.when(union > 0, shared / union), F.lit(0.0))


def edge_distance(a: Box, b: Box) -> Column:
    """The gap between the nearest edges; 0 if the boxes touch or overlap."""
    dx = F.greatest(F.lit(0), F.greatest(a.x1, b.x1) - F.least(a.x2, b.x2))
    dy = F.greatest(F.lit(0), F.greatest(a.y1, b.y1) - F.least(a.y2, b.y2))
    return F.hypot(dx.cast("double"), dy.cast("double"))


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def touches(a: Box, b: Box) -> Column:
    """Overlap that counts shared edges."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def same_subject(a: Box, b: Box, share: float = 0.5) -> Column:
    """Whether the overlap is more than ``share`` of the smaller box."""
    small = F.least(area(a), area(b))
    return F.coalesce((small > 0) & (overlap_area(a, b) > share * small), F.lit(False))


def padded(b: Box, pad: float, frame_w: Column | int, frame_h: Column | int) -> Box:
    """The box grown by a share of its size on each side, cut at the frame; whole pixels."""
    w, h = F.lit(frame_w) if isinstance(frame_w, int) else frame_w, F.lit(frame_h) if isinstance(frame_h, int) else frame_h
    dx, dy = width(b) * F.lit(pad), height(b) * F.lit(pad)
    return Box(F.greatest(F.lit(0), (b.x1 - dx).cast("int")), F.greatest(F.lit(0), (b.y1 - dy).cast("int")), F.least(w, (b.x2 + dx).cast("int")), F.least(h, (b.y2 + dy).cast("int")))


def region_id(x: Column, y: Column, frame_w: int, frame_h: int, cols: int = 4, rows: int = 3) -> Column:
    """The grid cell ``r<row>c<col>`` of a point; points outside fall into the nearest cell."""
    at = lambda v, cells, full: F.least(F.lit(cells - 1), F.greatest(F.lit(0), (v * cells / float(full)).cast("int")))
    return F.format_string("r%dc%d", at(y, rows, frame_h), at(x, cols, frame_w))


def head_yaw(nose: Column, left_shoulder: Column, right_shoulder: Column) -> Column:
    """(dl - dr) / (dl + dr) of the horizontal distances from the nose to both shoulders; null if it is over both."""
    dl, dr = F.abs(nose - left_shoulder), F.abs(nose - right_shoulder)
    return F.when(dl + dr >= 1e-6, (dl - dr) / (dl + dr))


def wrist_lift(shoulder_y: Column, shoulder_width: Column, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """(lift, conf): how far the higher seen wrist is over the shoulders in their widths, and how surely it was seen.

    Wrists are (y, confidence) with a null y if not seen; the left one of equals; null under one pixel of width.
    """
    lift = lambda y: F.when(shoulder_width >= 1, (shoulder_y - y) / shoulder_width)
    sides = [F.when(lift(y).isNotNull(), F.struct(lift(y).alias("lift"), F.lit(-i).alias("side"), c.alias("conf"))) for i, (y, c) in enumerate((left, right))]
    return F.array_max(F.array_compact(F.array(*sides)))


def torso_length(shoulder_y: Column, left_hip_y: Column, right_hip_y: Column) -> Column:
    """From the shoulder line to the mean of the hips that are seen."""
    hips = F.array_compact(F.array(left_hip_y, right_hip_y))
    mean = F.aggregate(hips, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(hips), F.lit(0))
    return F.abs(mean - shoulder_y)


def weighted_centre(boxes: str = "boxes") -> tuple[Column, Column]:
    """The centre of an array of boxes, each weighted by its area; null if all are empty."""
    total = lambda value: F.aggregate(boxes, F.lit(0.0), lambda s, b: s + value(b))
    size = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    whole = F.nullif(total(size), F.lit(0.0))
    return total(lambda b: (b["x1"] + b["x2"]) / 2.0 * size(b)) / whole, total(lambda b: (b["y1"] + b["y2"]) / 2.0 * size(b)) / whole


def confident(value: Column, confidence: Column, least: float = 0.5) -> Column:
    """The value of a keypoint that is seen well enough, else null."""
    return F.when(confidence >= least, value)
