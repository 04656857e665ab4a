"""Regions of interest: filters, pairs within a frame, unions and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, area, box, edge_distance, height, iou, width
from .spatial import box_pairs


def plausible(b, filled: Column, frame_area: int, least: float = 0.001, most: float = 0.5, aspect: float = 8.0, fill: float = 0.15) -> Column:  # noqa: ANN001
    """Whether a component is of a believable size, shape and density."""
    w, h = width(b), height(b)
    shape = F.greatest(w / h, h / w)
    return (w >= 1) & (h >= 1) & (area(b) >= int(least * frame_area)) & (area(b) <= int(most * frame_area)) & (shape <= aspect) & (filled >= fill)


def overlay(b, cls: Column, frame_height: int, top: float = 0.10, bottom: float = 0.92, least_area: int = 250) -> Column:  # noqa: ANN001
    """Whether a detection is likely part of an on-screen display rather than the scene."""
    ratio = width(b) / height(b)
    square_phone = (cls == "cell phone") & (ratio > 0.80) & (ratio < 1.25)
    return (F.lit(frame_height) > 0) & ((b.y2 <= top * frame_height) | (b.y1 >= bottom * frame_height) | (area(b) < least_area) | square_phone)


def prohibited(cls: Column, conf: Column, least: float = 0.35) -> Column:
    return cls.isin("cell phone", "book") & (conf >= least)


def relevant(b, cls: Column, conf: Column, frame_height: int) -> Column:  # noqa: ANN001
    """Persons, and prohibited objects that are not part of an on-screen display."""
    return (cls == "person") | (prohibited(cls, conf) & ~overlay(b, cls, frame_height))


def pairs(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different boxes with the same keys, as columns a_* and b_*."""
    edges = ("box_id", "x1", "y1", "x2", "y2")
    a = boxes.select(*keys, *[F.col(e).alias(f"a_{e}") for e in edges])
    b = boxes.select(*keys, *[F.col(e).alias(f"b_{e}") for e in edges])
    return a.join(b, keys).where("a_box_id < b_box_id")


def close_pairs(boxes: DataFrame, keys: list[str], least_iou: float = 0.05, distance: float = 30.0) -> DataFrame:
    """Pairs in a frame that overlap enough or lie near each other."""
    p = box_pairs(boxes, keys, distance / 2 * (1 + 1e-9)).withColumns({"iou": iou(box("a_"), box("b_")), "distance": edge_distance(box("a_"), box("b_"))})
    return p.where((F.col("iou") > least_iou) | (F.col("distance") <= distance))


def union_box() -> list[Column]:
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def merged(boxes: DataFrame, keys: list[str], least_fill: float = 0.15, least_iou: float = 0.05, distance: float = 30.0) -> DataFrame:
    """Boxes of a frame merged where they are close, unless the merged box would be mostly empty.

    ``box_id`` must be unique in a frame; the least of a group is its ``root``.  Groups that are too empty give their
    members back.  Nothing leaves its frame, so each frame's boxes are folded into groups in one aggregation: a box
    joins all groups that have a box close to it.
    """
    item = F.struct("box_id", "x1", "y1", "x2", "y2")
    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_boxes"))
    kind = dict(rows.dtypes)["_boxes"]
    at = lambda s: Box(s["x1"], s["y1"], s["x2"], s["y2"])

    def step(groups: Column, cur: Column) -> Column:
        close = lambda m: (iou(at(m), at(cur)) > least_iou) | (edge_distance(at(m), at(cur)) <= distance)
        near = lambda g: F.exists(g, close)
        return F.concat(F.filter(groups, lambda g: ~near(g)), F.array(F.concat(F.flatten(F.filter(groups, near)), F.array(cur))))

    groups = rows.select(*keys, F.explode(F.aggregate("_boxes", F.array().cast(f"array<{kind}>"), step)).alias("_g"))
    most = lambda e: F.array_max(F.transform("_g", lambda m: m[e]))
    least = lambda e: F.array_min(F.transform("_g", lambda m: m[e]))
    size = F.aggregate("_g", F.lit(0).cast("bigint"), lambda s, m: s + area(at(m)).cast("bigint"))
    whole = groups.select(*keys, "_g", least("box_id").alias("root"), least("x1").alias("x1"), least("y1").alias("y1"), most("x2").alias("x2"), most("y2").alias("y2"), size.alias("area"), F.size("_g").cast("bigint").alias("merged_from"))
    sparse = (F.col("merged_from") > 1) & (F.col("area") / area(box()) < least_fill)
    one = F.struct("root", "x1", "y1", "x2", "y2", "area", "merged_from")
    kind = one_type(dict(whole.dtypes))
    alone = F.transform("_g", lambda m: F.struct(m["box_id"].alias("root"), m["x1"].alias("x1"), m["y1"].alias("y1"), m["x2"].alias("x2"), m["y2"].alias("y2"), area(at(m)).cast("bigint").alias("area"), F.lit(1).cast("bigint").alias("merged_from")))
    return whole.select(*keys, F.inline(F.when(sparse, alone.cast(f"array<{kind}>")).otherwise(F.array(one))))


def one_type(types: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{c}:{types[c]}" for c in ("root", "x1", "y1", "x2", "y2", "area", "merged_from")) + ">"
