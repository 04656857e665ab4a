"""Tracks and detections: rollups, assignments, the tracker and non-maximum suppression."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, box, centre_distance, iou, touches, width
from .rois import prohibited
from .spatial import box_join, box_pairs

EDGES = ("x1", "y1", "x2", "y2")
#: Boxes that the tracker takes at a time, and shifts at which they are compared before the overlaps are reckoned.
PIECE, SHIFTS = 4096, 64


def rollup(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """First and last sighting, how many, and their mean confidence."""
    return sightings.groupBy(*keys).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("sightings"), F.round(F.avg("conf"), 8).alias("mean_conf"))


def best_sighting(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """The frame and box of the most confident sighting; the first frame and box of equals."""
    return sighted(sightings, keys).drop("sightings")


def sighted(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """The same with the number of ``sightings``."""
    first = ("frame_idx", "roi_id", "source_id", *EDGES)
    # the order holds all that is asked for, so nothing goes along with it
    best = F.max(F.struct("conf", *[(-F.col(c)).alias(c) for c in first])).alias("best")
    found = sightings.groupBy(*keys).agg(best, F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("sightings"))
    of = lambda c: F.col(f"best.{c}") if c == "conf" else -F.col(f"best.{c}")
    return found.select(*keys, *[of(c).alias(c) for c in ("frame_idx", "roi_id", "conf", *EDGES)], "start", "end", "sightings")


def detection_summary(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of persons and objects, the kinds seen, and whether there is a phone or paper."""
    return sightings.groupBy(*keys).agg(
        F.count_if(F.col("cls") == "person").alias("persons"), F.count_if(F.col("cls") != "person").alias("objects"), F.array_join(F.array_sort(F.collect_set("cls")), ",").alias("kinds"),
        F.bool_or((F.col("cls") == "cell phone") & (F.col("conf") >= 0.35)).alias("has_phone"), F.bool_or((F.col("cls") == "book") & (F.col("conf") >= 0.35)).alias("has_paper"), F.round(F.coalesce(F.max(F.when(prohibited(F.col("cls"), F.col("conf")), F.col("conf"))), F.lit(0.0)), 3).alias("object_score"),
    )


def carriers(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Each object with the first track whose box it touches in its frame; null if none does."""
    objects = boxes.where("cls <> 'person'").select(*keys, "box_id", *[F.col(e).alias(f"a_{e}") for e in ("x1", "y1", "x2", "y2")])
    persons = boxes.where("cls = 'person'").select(*keys, "track_id", *[F.col(e).alias(f"b_{e}") for e in ("x1", "y1", "x2", "y2")])
    held = box_join(objects, persons, keys).where(touches(box("a_"), box("b_"))).select(*keys, "box_id", "track_id")
    # a row without a track for each object, so that those that nobody touches stay
    alone = objects.select(*keys, "box_id", F.lit(None).cast(held.schema["track_id"].dataType).alias("track_id"))
    return held.unionByName(alone).groupBy(*keys, "box_id").agg(F.min("track_id").alias("carrier"))


def assigned(poses: DataFrame, tracks: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """Each pose with the track box of its frame that it overlaps most, over ``least``; the first of equals."""
    p = poses.select(*keys, F.col("box_id").alias("pose_id"), *[F.col(e).alias(f"a_{e}") for e in ("x1", "y1", "x2", "y2")])
    t = tracks.select(*keys, "track_id", *[F.col(e).alias(f"b_{e}") for e in ("x1", "y1", "x2", "y2")])
    scored = box_join(p, t, keys).withColumn("overlap", iou(box("a_"), box("b_"))).where(F.col("overlap") > least)
    return scored.groupBy(*keys, "pose_id").agg(F.max_by("track_id", F.struct("overlap", -F.col("track_id"))).alias("track_id"), F.round(F.max("overlap"), 6).alias("overlap"))


def proximity(boxes: DataFrame, group: list[str], frame: str = "frame_idx", reach: float = 1.5) -> DataFrame:
    """The largest share of a frame's persons who are near another one, over frames with two or more."""
    persons = boxes.where("cls = 'person'")
    keys = [*group, frame]
    # a person who is near by the wider one's measure lies within that one's reach
    pairs = box_pairs(persons, keys, (width(box()) + 1) * reach)
    near = pairs.where(centre_distance(box("a_"), box("b_")) / (F.greatest(width(box("a_")), width(box("b_"))) + 1) < reach)
    close = near.select(*keys, F.explode(F.array("a_box_id", "b_box_id")).alias("box_id")).groupBy(*keys).agg(F.count_distinct("box_id").alias("close"))
    frames = persons.groupBy(*keys).agg(F.count(F.lit(1)).alias("persons")).where("persons >= 2").join(close, keys, "left").fillna({"close": 0})
    return frames.groupBy(*group).agg(F.round(F.max(F.col("close") / F.col("persons")), 3).alias("proximity"), F.count(F.lit(1)).alias("frames"))


def suppressed(detections: DataFrame, keys: list[str], most: float = 0.4) -> DataFrame:
    """(keys, box_id, cls, conf) after greedy non-maximum suppression within each frame and class, most confident first.

    Order decides, so each frame's few boxes are folded in the JVM: a box stays if no box
    of its class that stayed before overlaps it by more than ``most``.
    """
    item = F.struct((-F.col("conf")).alias("rank"), "box_id", "cls", "conf", "x1", "y1", "x2", "y2")
    rows = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    kind = dict(rows.dtypes)["boxes"]
    at = lambda s: Box(s["x1"], s["y1"], s["x2"], s["y2"])

    def step(kept: Column, cur: Column) -> Column:
        hit = F.exists(kept, lambda k: (k["cls"] == cur["cls"]) & (iou(at(k), at(cur)) > most))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(cur)))

    folded = rows.select(*keys, F.aggregate("boxes", F.array().cast(kind), step).alias("kept"))
    return folded.select(*keys, F.inline("kept")).select(*keys, "box_id", "cls", "conf")


class Tracker:
    """Greedy overlap tracking of one video: tracks take the best free detection in order of creation."""

    def __init__(self, least: float = 0.3, max_age: int = 30, min_hits: int = 3):
        self.least, self.max_age, self.min_hits = least, max_age, min_hits
        self.boxes = np.zeros((0, 4))
        self.state = np.zeros((0, 3), np.int64)  # number, hits, last step
        self.made = 0

    def update(self, boxes: np.ndarray, step: int) -> list[tuple[int, int]]:
        """(detection, track number) of the confirmed tracks that were matched in this step."""
        overlap, out = overlaps(self.boxes, boxes), []
        for i in np.flatnonzero(overlap.max(axis=1, initial=0.0) > self.least):
            j = int(overlap[i].argmax())
            if overlap[i, j] > self.least:
                overlap[:, j] = -1.0  # taken
                self.boxes[i] = boxes[j]
                self.state[i, 1:] = self.state[i, 1] + 1, step
                if self.state[i, 1] >= self.min_hits:
                    out.append((j, int(self.state[i, 0])))
        new = np.flatnonzero(overlap.max(axis=0) >= 0.0) if len(self.boxes) else np.arange(len(boxes))
        self.boxes = np.concatenate([self.boxes, boxes[new]])
        self.state = np.concatenate([self.state, np.stack([self.made + 1 + np.arange(len(new)), np.ones(len(new), np.int64), np.full(len(new), step)], axis=1)])
        self.made += len(new)
        keep = step - self.state[:, 2] <= self.max_age
        self.boxes, self.state = self.boxes[keep], self.state[keep]
        return out


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all boxes of ``a`` with all of ``b``."""
    return paired(a[:, None], b[None, :])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes that stand at the same place."""
    size = np.maximum(0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]))
    shared = size[..., 0] * size[..., 1]
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    union = area(a) + area(b) - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def overlapping(step: np.ndarray, boxes: np.ndarray, since: int, reach: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(earlier, later, overlap): rows at most ``reach`` steps apart that overlap by over ``least``, by the later one's step; that one is row ``since`` or after.

    Rows stand in order of ``step``. All are compared with those k places before, for each k in reach.
    """
    n, found = len(step), []
    x1, y1, x2, y2 = np.ascontiguousarray(boxes.T)
    far = int((np.arange(since, n) - np.searchsorted(step, step[since:] - reach)).max(initial=0))
    for some in range(1, far + 1, SHIFTS):
        hits = []
        for k in range(some, min(some + SHIFTS, far + 1)):
            begin = max(since, k)
            old, new = slice(begin - k, n - k), slice(begin, n)
            hits.append(np.flatnonzero((x1[old] < x2[new]) & (x1[new] < x2[old]) & (y1[old] < y2[new]) & (y1[new] < y2[old])) + begin)
        later = np.concatenate(hits)
        earlier = later - np.repeat(np.arange(some, some + len(hits)), [len(h) for h in hits])
        apart = step[later] - step[earlier]
        near = (apart >= 1) & (apart <= reach)
        earlier, later = earlier[near], later[near]
        overlap = paired(boxes[earlier], boxes[later])
        much = overlap > least
        found.append((earlier[much], later[much], overlap[much]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    earlier, later, overlap = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(step[later], kind="stable")
    return earlier[order], later[order], overlap[order]


class Trackers:
    """``Tracker`` over the frames of one video after another, many frames at a time.

    A track's box is its last detection, so tracks are known by rows, and overlaps are reckoned for
    many frames at once; only pairs that overlap are then gone through in order. Held from piece to piece are the
    open tracks' rows: their step, box, number (counted over all videos) and hits.
    """

    def __init__(self, least: float = 0.3, max_age: int = 30, min_hits: int = 3):
        self.least, self.reach, self.min_hits = least, max_age + 1, min_hits
        self.step, self.boxes = np.zeros(0, np.int64), np.zeros((0, 4))
        self.number, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = self.made = self.before = 0  # the last step, all tracks, those of earlier videos

    def update(self, boxes: np.ndarray, frame: np.ndarray, video: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number in its video) of the detections that continue a confirmed track; ``frame`` and ``video`` tell which rows begin one."""
        old, n = len(self.step), len(boxes)
        # no track reaches into the next video
        step = np.concatenate([self.step, self.last + np.cumsum(np.where(video, self.reach + 1, frame))])
        boxes = np.concatenate([self.boxes, boxes])
        # until it is known which rows begin a track, each has a number of its own, in the same order
        number, hits = [*self.number.tolist(), *range(self.made + 1, self.made + n + 1)], [*self.hits.tolist(), *[1] * n]
        gone, matched = bytearray(old + n), bytearray(old + n)

        def settle(pairs: list[tuple]) -> None:
            for track, _, new, row in sorted(pairs) if len(pairs) > 1 else pairs:
                if not (gone[row] or matched[new]):
                    gone[row] = matched[new] = 1
                    number[new], hits[new] = track, hits[row] + 1

        earlier, later, overlap = overlapping(step, boxes, old, self.reach, self.least)
        pairs, at = [], None
        for row, new, size, when in zip(earlier.tolist(), later.tolist(), (-overlap).tolist(), step[later].tolist(), strict=True):
            if when != at:
                settle(pairs)
                pairs, at = [], when
            if not gone[row]:
                pairs.append((number[row], size, new, row))
        settle(pairs)

        begun = np.cumsum(np.frombuffer(matched, np.uint8)[old:] == 0)
        number, hits = np.array(number, np.int64), np.array(hits, np.int64)
        own = number > self.made
        number[own] = self.made + begun[number[own] - self.made - 1]
        # the tracks of all videos before each row's own
        starts = np.flatnonzero(video)
        before = np.concatenate([[self.before], self.made + np.concatenate([[0], begun])[starts]])[np.cumsum(video)]
        sure = np.flatnonzero(hits[old:] >= self.min_hits)
        out = sure, number[old:][sure] - before[sure]
        if n:
            self.last, self.before, self.made = int(step[-1]), int(before[-1]), self.made + int(begun[-1])
        keep = (np.frombuffer(gone, np.uint8) == 0) & (self.last - step < self.reach)
        self.step, self.boxes, self.number, self.hits = step[keep], boxes[keep], number[keep], hits[keep]
        return out


def begins(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; nulls are equal."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.diff(codes, prepend=-2) != 0


def tracked(detections: DataFrame) -> DataFrame:
    """(video_id, frame_idx, box_id, track): the tracker over each video's frames in order.

    Boxes stream by in order, and only the open tracks and whole frames of about ``PIECE`` boxes are held.
    """
    rows = detections.where("box_id is not null").select("video_id", "frame_idx", "box_id", *EDGES)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trackers, rest, opens = Trackers(), None, True
        for batch in batches:
            if batch.num_rows:
                rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                video = begins(rows.column(0))
                frame = video | begins(rows.column(1))
                video[0] = opens
                # the last frame may go on in the next batch
                end = int(np.flatnonzero(frame)[-1])
                yield from found(trackers, rows.slice(0, end), frame[:end], video[:end])
                rest, opens = rows.slice(end), bool(video[end])
        if rest is not None:
            frame = np.arange(rest.num_rows) == 0
            yield from found(trackers, rest, frame, frame & opens)

    def found(trackers: Trackers, rows: pa.RecordBatch, frame: np.ndarray, video: np.ndarray) -> Iterator[pa.RecordBatch]:
        boxes = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in rows.columns[3:]], axis=1)
        starts = np.flatnonzero(frame)
        cuts = [*starts[np.flatnonzero(np.diff(starts // PIECE, prepend=-1))].tolist(), rows.num_rows]
        for a, b in pairwise(cuts):
            at, numbers = trackers.update(boxes[a:b], frame[a:b], video[a:b])
            if len(at):
                names = pa.array([f"Track-{n:02d}" for n in numbers.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at + a)) for c in rows.columns[:3]), names], names=["video_id", "frame_idx", "box_id", "track"])

    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "box_id", *EDGES)
    return ordered.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in ("video_id", "frame_idx", "box_id")) + ", track string")


def latest_boxes(tracks: DataFrame) -> Window:
    """Window of a track's boxes in order of time."""
    return Window.partitionBy("video_id", "track_id").orderBy("t", "frame_idx", "box_id", *EDGES)
