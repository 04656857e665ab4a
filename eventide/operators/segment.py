"""Event segmentation of a score series, and scan windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import primary_label
from . import scans
from .quantiles import exact_percentiles
from .windows import interval_join


@dataclass(frozen=True)
class Thresholds:
    """Seconds, and score bounds of the hysteresis; the defaults are those of production."""

    start: float = 0.10
    end: float = 0.05
    min_duration: float = 1.5
    merge_gap: float = 2.0
    padding: float = 3.0


def segment(frames: DataFrame, th: Thresholds = Thresholds(), column: str = "s_final") -> DataFrame:
    """(video_id, event_id, kind, start, end, unpadded_start, unpadded_end, merges) from (video_id, frame_idx, t, score).

    Hysteresis, merge of gaps, split by duration, padding of the long ones and merge of what
    then overlaps.  An event ends at the first frame under the lower bound.
    """
    timed = scans.series(frames.select("video_id", "frame_idx", "t", column), ["video_id"], ["t", "frame_idx"])
    state = scans.latched(timed, F.col(column), th.start, th.end)
    state = scans.scanned(state, before=scans.ago(F.col("on"), 1), next_t=scans.following(F.col("t")), video_end=scans.overall(F.col("t")))
    began = (F.col("on") == 1) & (F.coalesce("before", F.lit(0)) == 0)
    runs = scans.scanned(state, run=scans.total(began.cast("long"))).rows.where("on = 1")
    raw = runs.groupBy("video_id", "run").agg(F.min("t").alias("start"), F.max(F.coalesce("next_t", "video_end")).alias("end"), F.first("video_end").alias("video_end"))

    merged = scans.merged_intervals(raw, ["video_id"], th.merge_gap, aggs=[F.first("video_end").alias("video_end")])
    long = F.col("end") - F.col("start") >= th.min_duration
    bounds = [F.col("start").alias("unpadded_start"), F.col("end").alias("unpadded_end")]
    short = merged.where(~long).select("video_id", F.lit("short_motion").alias("kind"), "start", "end", *bounds, F.lit(0).cast("long").alias("merges"))

    padded = merged.where(long).select("video_id", F.greatest(F.lit(0.0), F.col("start") - th.padding).alias("start"), F.least("video_end", F.col("end") + th.padding).alias("end"), *bounds)
    full = scans.merged_intervals(padded, ["video_id"], 0.0, aggs=[F.min("unpadded_start").alias("unpadded_start"), F.max("unpadded_end").alias("unpadded_end")])
    both = full.select("video_id", F.lit("full_event").alias("kind"), "start", "end", "unpadded_start", "unpadded_end", (F.col("merged") - 1).alias("merges")).unionByName(short)
    return scans.scanned(scans.series(both, ["video_id"], ["start", "unpadded_start", "kind"]), event_id=scans.number()).frame()


def event_statistics(events: DataFrame, frames: DataFrame, tick: float, digits: int = 4) -> DataFrame:
    """Statistics of the frames between an event's unpadded bounds, both included; events without frames go."""
    e = events.select("video_id", "event_id", "kind", "unpadded_start", "unpadded_end")
    joined = interval_join(frames, e, ["video_id"], "t", "unpadded_start", "unpadded_end", tick)
    stats = joined.groupBy("video_id", "event_id", "kind").agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.max("s_final"), digits).alias("peak"), F.round(F.avg("s_final"), digits).alias("mean"), F.round(F.min("s_final"), digits).alias("least"), F.round(F.max("score"), digits).alias("peak_evidence"), F.round(F.avg("q"), digits).alias("mean_q"), F.sum("flag").alias("camera_frames"),
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"),
    )
    share = F.round(F.col("camera_frames") / F.col("frames"), digits)
    return stats.withColumn("camera_share", share).withColumn("label", primary_label(F.col("camera_share")))


def scan_windows(samples: DataFrame, value: str = "activity", share: float = 0.75, floor: float = 0.02, pad: float = 5.0, gap: float = 3.0, least: float = 1.0) -> DataFrame:
    """Windows of a coarse scan that are worth a fine one.

    The threshold is the video's own percentile, not under ``floor``.  Numbers are given
    before short windows go, so they may skip.
    """
    limits = exact_percentiles(samples, ["video_id"], {"p": (value, share)}).join(samples.groupBy("video_id").agg(F.max("t").alias("video_end")), "video_id").withColumn("threshold", F.greatest(F.col("p"), F.lit(floor)))
    active = samples.join(limits, "video_id").where(F.col(value) >= F.col("threshold"))
    padded = active.select("video_id", "threshold", "video_end", F.greatest(F.lit(0.0), F.col("t") - pad).alias("start"), F.least("video_end", F.col("t") + pad).alias("end"))
    merged = scans.merged_intervals(padded, ["video_id"], gap, aggs=[F.count(F.lit(1)).alias("samples"), F.first("threshold").alias("threshold"), F.first("video_end").alias("video_end")])
    return merged.withColumn("window_id", F.format_string("W%02d", F.col("_nth"))).where(F.col("end") - F.col("start") >= least).drop("_nth")


def coverage(windows: DataFrame, videos: DataFrame) -> DataFrame:
    """The share of each video that its windows cover."""
    total = windows.groupBy("video_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("windows"))
    joined = videos.join(total, "video_id", "left").fillna({"covered": 0.0, "windows": 0})
    return joined.withColumn("coverage", F.coalesce(F.try_divide("covered", "duration"), F.lit(0.0)))


def activity_buckets(events: DataFrame, videos: DataFrame, buckets: int = 48) -> DataFrame:
    """How many events reach into each of a video's equal stretches; touching ends do not count.

    Each event is dealt to the stretches it reaches, so no event meets a stretch it does not touch.
    """
    step = F.col("length") / buckets
    e = events.join(videos, "video_id").where(F.col("end") > F.col("start"))
    lo = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("origin")) / step)).cast("int")
    hi = F.least(F.lit(buckets - 1), F.ceil((F.col("end") - F.col("origin")) / step) - 1).cast("int")
    e = e.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("bucket", F.explode(F.sequence("lo", "hi")))
    return e.groupBy("video_id", "bucket").agg(F.count(F.lit(1)).alias("events"))
