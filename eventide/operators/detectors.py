"""Rule detectors over tracks and objects; those over poses are in ``poses``, and ``findings`` gives all one schema."""

from __future__ import annotations

from collections.abc import Callable
from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, width
from .spatial import box_join
from .streams import folded
from .tracks import latest_boxes
from .windows import islands, latest, ordered

EDGES = ["x1", "y1", "x2", "y2"]
BOX_ORDER = ["t", "frame_idx", "box_id", *EDGES]


def loiter_step(anchor: dict | None, cur: dict, least_seconds: float, reach: float) -> tuple[dict, list[tuple]]:
    """(anchor after a box, the stretch that it completes if any)."""
    if anchor is None:
        return cur, []
    dx, dy = ((cur[p] + cur[q]) // 2 - (anchor[p] + anchor[q]) // 2 for p, q in (("x1", "x2"), ("y1", "y2")))
    still = cur["t"] - anchor["t"]
    if hypot(dx, dy) / max(anchor["x2"] - anchor["x1"] + 1, anchor["y2"] - anchor["y1"] + 1) > reach:
        return cur, []
    if still >= least_seconds:
        return cur, [(anchor["t"], cur["t"], cur["frame_idx"], *(cur[e] for e in EDGES), float(still))]
    return anchor, []


def stationary(tracks: DataFrame, least_seconds: float, reach: float = 0.75) -> DataFrame:
    """Loitering: stretches in which a track stays near an anchor for ``least_seconds``.

    (video_id, track_id, start, end, frame_idx, box, duration, confidence): the box is the one that completes the
    stretch, the confidence the track's mean.  A box further than ``reach`` of the anchor's size becomes the anchor;
    so does the one that completes a stretch.
    """

    def fold() -> Callable[[dict], list[tuple]]:
        anchor: dict | None = None

        def step(cur: dict) -> list[tuple]:
            nonlocal anchor
            anchor, found = loiter_step(anchor, cur, least_seconds, reach)
            return [(*stretch, cur["confidence"]) for stretch in found]

        return step

    keys = ["video_id", "track_id"]
    out = "start double, end double, frame_idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, duration double, confidence double"
    found = folded(tracks.select(*keys, *BOX_ORDER, "conf"), keys, BOX_ORDER, fold, out, whole={"confidence": F.avg("conf")})
    return found.withColumn("confidence", F.round("confidence", 8))


def crowd_runs(tracks: DataFrame, least_drift: float = 0.35, persons: int = 3, gap: float = 6, frames: int = 3, time: str = "day", times: Column | None = None) -> DataFrame:
    """Crowd disturbance: one finding per video that spans all long enough runs of times with several movers.

    ``peak_at`` is the first time with the most movers.  ``times`` gives the time of a box if it is no column yet: it need not be moved then.
    """
    w = latest_boxes(tracks)
    b = box()
    cx, cy = (((a + z) / 2).cast("long") for a, z in ((b.x1, b.x2), (b.y1, b.y2)))  # whole pixels, as for those who stay
    moved = F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w)) / (width(b) + 1)
    movers = tracks.withColumn("drift", moved).where(F.col("drift") >= least_drift)
    movers = movers if times is None else movers.withColumn(time, times)
    busy = movers.groupBy("video_id", time).agg(F.count_distinct("track_id").alias("movers")).where(F.col("movers") >= persons)
    order = ordered(["video_id"], time)
    before = F.lag(time).over(order)
    top = F.struct(F.col("movers").alias("movers"), (-F.col(time)).alias("early"))
    runs = busy.withColumn("run", islands(before.isNull() | (F.col(time) - before > gap), order)).groupBy("video_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start"), F.max(time).alias("end"), F.max(top).alias("top")).where(F.col("n") >= frames)
    out = runs.groupBy("video_id").agg(F.count(F.lit(1)).alias("runs"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("top").alias("top"))
    out = out.select("video_id", "runs", "start", "end", F.col("top.movers").alias("peak"), (-F.col("top.early")).alias("peak_at"))
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("peak") / (persons + 2)), 4))


def exchanges(objects: DataFrame, hands: DataFrame, keys: list[str], reach: float = 0.9) -> DataFrame:
    """Objects that two or more tracks have a hand near, in the first such frame of each class.

    ``hands`` has (keys, frame_idx, track_id, hx, hy, shoulder), as ``poses.hands`` gives them; ``objects`` has (keys, frame_idx, t, cls, conf, object_id,
    box).  The result has the object's columns, ``people``, and the first two tracks in order of their text as ``track_id`` and ``other_id``.
    """
    about = ["frame_idx", "cls", "object_id", "t", "conf", *EDGES]
    b = box()
    cx, cy = (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0
    far = F.col("shoulder") * reach
    centres = objects.withColumns({"a_x1": cx, "a_x2": cx, "a_y1": cy, "a_y2": cy})
    around = hands.withColumns({"b_x1": F.col("hx") - far, "b_x2": F.col("hx") + far, "b_y1": F.col("hy") - far, "b_y2": F.col("hy") + far})
    near = box_join(centres, around, [*keys, "frame_idx"]).where(F.hypot(F.col("hx") - F.col("a_x1"), F.col("hy") - F.col("a_y1")) / F.col("shoulder") < reach)
    names = F.array_sort(F.collect_set(F.struct(F.col("track_id").cast("string").alias("name"), "track_id")))
    shared = near.groupBy(*keys, *about).agg(F.count_distinct("track_id").alias("people"), names.alias("_all")).where("people >= 2")
    shared = shared.withColumns({"track_id": F.get("_all", F.lit(0))["track_id"], "other_id": F.get("_all", F.lit(1))["track_id"]})
    return latest(shared.drop("_all"), [*keys, "cls"], "frame_idx", "object_id")
