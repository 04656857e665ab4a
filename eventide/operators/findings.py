"""Findings of all detectors in one schema, with the subject's box, and what is attached to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import fixed
from ..functions.scalars import grounding, prohibited_label
from . import detectors, poses, tracks
from .rois import prohibited

KEY = ["video_id"]
EDGES = ("x1", "y1", "x2", "y2")
COLUMNS = ["video_id", "type", "label", "track_id", "start_sec", "end_sec", "frame_idx", "confidence", *EDGES, "sightings", "duration"]


#: What reviewers read.
HANDOFF = "%s at the hands of %s and %s (possible hand-off)"
STATIONARY = "Person stationary for %ss"
CROWD = "%d people moving simultaneously"
TURNED, AWAY = "Head turned ", ", away from their usual posture"
RAISED = "Hand raised above shoulder (possible signalling)"
OVER_BASELINE = "%s (region %s was %s sigma above its own baseline)"
USUAL = "%s (region %s was within its normal range)"
MOTION = "Motion peaked at %s over %d analysed frames (%s onset)"


def finding(rows: DataFrame, kind: str, label: Column, **columns: Column) -> DataFrame:
    """Rows in the common schema; what a detector does not know is null."""
    empty = {"track_id": "bigint", "start_sec": "double", "end_sec": "double", "frame_idx": "bigint", "confidence": "double", **dict.fromkeys(EDGES, "bigint"), "sightings": "bigint", "duration": "double"}
    found = {c: columns.get(c, F.lit(None)).cast(t) for c, t in empty.items()}
    return rows.select("video_id", F.lit(kind).alias("type"), label.alias("label"), *[v.alias(k) for k, v in found.items()]).select(*COLUMNS)


def prohibited_objects(sightings: DataFrame) -> DataFrame:
    """One finding per class: its first and last sighting, and the frame and box of the surest."""
    seen = sightings.where(prohibited(F.col("cls"), F.col("conf")))
    best = tracks.sighted(seen, [*KEY, "cls"])
    return finding(best, "prohibited_object", F.concat(prohibited_label(F.col("cls")), F.lit(" detected")), start_sec=F.col("start"), end_sec=F.col("end"), frame_idx=F.col("frame_idx"), confidence=F.col("conf"), sightings=F.col("sightings"), **{e: F.col(e) for e in EDGES})


def exchanges(objects: DataFrame, hands: DataFrame) -> DataFrame:
    found = detectors.exchanges(objects, hands, KEY)
    label = F.format_string(HANDOFF, prohibited_label(F.col("cls")), F.col("track_id").cast("string"), F.col("other_id").cast("string"))
    return finding(found, "object_exchange", label, track_id=F.col("track_id"), start_sec=F.col("t"), end_sec=F.col("t"), frame_idx=F.col("frame_idx"), confidence=F.col("conf"), sightings=F.col("people"), **{e: F.col(e) for e in EDGES})


def loitering(boxes: DataFrame, least_seconds: float, reach: float = 0.75) -> DataFrame:
    found = detectors.stationary(boxes, least_seconds, reach)
    label = F.format_string(STATIONARY, fixed(F.col("duration"), 0))
    return finding(found, "loitering", label, track_id=F.col("track_id"), start_sec=F.col("start"), end_sec=F.col("end"), frame_idx=F.col("frame_idx"), confidence=F.col("confidence"), duration=F.col("duration"), **{e: F.col(e) for e in EDGES})


def crowds(boxes: DataFrame, **rules: float | Column) -> DataFrame:
    found = detectors.crowd_runs(boxes, **rules)
    return finding(found, "crowd_disturbance", F.format_string(CROWD, F.col("peak")), start_sec=F.col("start"), end_sec=F.col("end"), frame_idx=F.col("peak_at"), confidence=F.col("confidence"), sightings=F.col("peak"))


def turns(measured: DataFrame, postures: DataFrame | None = None) -> DataFrame:
    found = poses.head_turns(measured, [*KEY, "track_id"], postures=postures)
    label = F.concat(F.lit(TURNED), F.col("direction"), F.lit(AWAY))
    return finding(found, "head_turn", label, track_id=F.col("track_id"), start_sec=F.col("start"), end_sec=F.col("end"), frame_idx=F.col("peak_frame"), confidence=F.col("confidence"), duration=F.col("end") - F.col("start"))


def raises(measured: DataFrame, postures: DataFrame | None = None) -> DataFrame:
    found = poses.hand_raises(measured, [*KEY, "track_id"], postures=postures)
    return finding(found, "hand_gesture", F.lit(RAISED), track_id=F.col("track_id"), start_sec=F.col("start"), end_sec=F.col("end"), frame_idx=F.col("peak_frame"), confidence=F.col("confidence"), duration=F.col("end") - F.col("start"))


def together(*found: DataFrame) -> DataFrame:
    """The findings of all detectors."""
    return reduce(DataFrame.unionByName, found)


def with_subject_box(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """Findings without a box of their own get that of their subject in their frame, the first of several."""
    order = F.struct(*[c for c in ("box_id",) if c in boxes.columns], *EDGES)
    own = boxes.groupBy(*KEY, "track_id", "frame_idx").agg(F.min_by(F.struct(*EDGES), order).alias("_box"))
    # only a subject's finding is looked up: keys with a null never meet
    j = found.join(own, [*KEY, "track_id", "frame_idx"], "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_box.{c}").cast("bigint")).alias(c) if c in EDGES else F.col(c) for c in COLUMNS])


def with_stills(found: DataFrame, stills: DataFrame) -> DataFrame:
    """Adds ``still``: the snapshot of the finding's event and frame, else the annotated still of the frame, else the first sampled one of the
    video, else null.

    ``found`` has (event_id, video, frame_idx, start_frame); a finding without a frame, or with frame 0, takes that where its event begins, for
    which there are no snapshots.  ``stills`` is a listing (``readers.stills``): a row for each file, joined by number.
    """
    of = lambda kind, *keys: stills.where(F.col("kind") == kind).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("path").alias(f"_{kind}"))
    rows = found.withColumn("_at", F.when(F.coalesce("frame_idx", F.lit(0)) == 0, F.col("start_frame")).otherwise(F.col("frame_idx")))
    shots, marked, sampled = of("snapshot", "event_id", "frame_idx"), of("annotated", "frame_idx"), of("sampled", "video", "frame_idx")
    rows = rows.join(shots, (rows["event_id"] == shots["_event_id"]) & (rows["frame_idx"] == shots["_frame_idx"]), "left").drop("_event_id", "_frame_idx")
    rows = rows.join(marked, rows["_at"] == marked["_frame_idx"], "left").drop("_frame_idx")
    rows = rows.join(sampled, (rows["video"] == sampled["_video"]) & (rows["_at"] == sampled["_frame_idx"]), "left")
    return rows.withColumn("still", F.coalesce("_snapshot", "_annotated", "_sampled")).select(*found.columns, "still")


def references(frame: Column, still: Column, base: str = "/api/frame?idx=") -> Column:
    """What supports a claim: the address of its frame, and of its still if there is one."""
    return F.array_compact(F.array(F.concat(F.lit(base), frame.cast("string")), F.concat(F.lit("/api/snapshot?path="), still)))


def grounded(found: DataFrame, events: DataFrame, caveat: str = "caveat") -> DataFrame:
    """(event_id, claim, at, track_id, roi, box, urls, caveat): ``explained`` with the places that bear each claim out.

    ``found`` has also (frame_idx, still, x1, y1, x2, y2), ``events`` (start_frame, roi_x1, roi_y1, roi_x2, roi_y2).  The claim on an event's
    motion stands on the frame where it begins.  A claim with neither box, region nor still, or without words, is dropped.
    """
    roi = F.when(F.col("roi_x1").isNotNull(), F.array("roi_x1", "roi_y1", "roi_x2", "roi_y2"))
    own = F.when(F.col("x1").isNotNull(), F.array(*EDGES))
    e = events.select("event_id", roi.alias("roi"), F.col("start_frame"))
    claims = found.select("event_id", with_region_claim(found).alias("claim"), F.col("start_sec").alias("at"), "track_id", own.alias("box"), references(F.col("frame_idx"), F.col("still")).alias("urls"), caveat)
    claims = claims.join(e.select("event_id", "roi"), "event_id")
    motion = explained(found.where("false"), events, caveat).join(e, "event_id").select("event_id", "claim", "at", "track_id", F.lit(None).cast(claims.schema["box"].dataType).alias("box"), references(F.col("start_frame"), F.lit(None).cast("string")).alias("urls"), caveat, "roi")
    both = claims.unionByName(motion)
    held = grounding(F.col("box").isNotNull(), F.col("roi").isNotNull(), F.size("urls"), F.col("claim"))
    return both.where(held.isNotNull()).select("event_id", "claim", "at", "track_id", "roi", "box", "urls", caveat)


def with_region_claim(found: DataFrame, region: str = "region", z: str = "region_z") -> Column:
    """The label with how the region behaved: over its own baseline, or within its normal range."""
    over = F.format_string(OVER_BASELINE, F.col("label"), F.col(region), fixed(F.col(z), 1))
    usual = F.format_string(USUAL, F.col("label"), F.col(region))
    return F.when(F.coalesce(F.col(region), F.lit("")) == "", F.col("label")).when(F.col(z) != 0, over).otherwise(usual)


def explained(found: DataFrame, events: DataFrame, caveat: str = "caveat") -> DataFrame:
    """(event_id, claim, at, track_id, caveat): a claim for each finding, and one on the motion of each event."""
    claims = found.select("event_id", with_region_claim(found).alias("claim"), F.col("start_sec").alias("at"), "track_id", caveat)
    motion = F.format_string(MOTION, fixed(F.col("peak"), 2), F.col("frames"), F.coalesce(F.nullif("character", F.lit("")), F.lit("unclassified")))
    return claims.unionByName(events.select("event_id", motion.alias("claim"), F.col("start").alias("at"), F.lit(None).cast(found.schema["track_id"].dataType).alias("track_id"), caveat))


def near_explanations(found: DataFrame, claims: DataFrame, seconds: float = 4.0) -> DataFrame:
    """Each finding with its event's claims less than ``seconds`` from its start; findings without any stay.

    Both sides meet on the event and a bucket of time, so a long event is no nested loop.
    """
    bucket = lambda c: F.floor(F.col(c) / seconds)
    near = claims.select("event_id", "claim", "at", F.explode(F.array(*[bucket("at") + i for i in (-1, 0, 1)])).alias("_b"))
    close = F.abs(F.col("at") - F.col("start_sec")) < seconds
    f = found.withColumn("_b", bucket("start_sec"))
    return f.join(near, (f["event_id"] == near["event_id"]) & (f["_b"] == near["_b"]) & close, "left").select(*[f[c] for c in found.columns], "claim", "at")


def sorted_by(found: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Findings with their place in a group's list by time, confidence or type."""
    orders = {"time": ["start_sec"], "confidence": [F.desc("confidence")], "type": ["type", "start_sec"]}
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*orders[key], "finding_id")))


def capped(found: DataFrame, cap: int, group: list[str], order: list[str | Column]) -> DataFrame:
    """Rows with whether they are among the first ``cap`` of their group, and how many are left out."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return found.withColumns({"taken": n <= cap, "omitted": F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy(*group)) - cap)})
