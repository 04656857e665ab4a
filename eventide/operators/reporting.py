"""What reviewers read: events as an interface returns them, summaries, tiles, sorted and capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import fixed, math_round
from ..functions.scalars import event_kind, priority
from .quantiles import exact_percentiles
from .windows import ordered

#: How finding types are shown; others are shown as they are.
DISPLAY_NAMES = {
    "prohibited_object": "Prohibited Object",
    "object_exchange": "Object Exchange",
    "loitering": "Loitering",
    "crowd_disturbance": "Crowd Disturbance",
    "head_turn": "Head Turn",
    "hand_gesture": "Hand Gesture",
    "neighbour_reach": "Neighbour Reach",
}


def display_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(names[kind], kind)


# The sentences of the next two functions are what reviewers read.


def description(phone: Column, persons: Column, peak: Column, seen: Column) -> Column:
    """One sentence on what an event shows: phone, several persons, one person, or motion alone."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (
        F.when(phone, text("Person detected with cell phone (", persons, " tracks, ", fixed(peak * 100, 1), "% motion)"))
        .when(persons > 1, text("Multiple persons detected in proximity (", persons, " tracks)"))
        .when(persons == 1, text("Person detected with unusual motion (score: ", fixed(peak, 2), ")"))
        .otherwise(text("Motion detected (score: ", fixed(peak, 2), ", observability: ", fixed(seen, 2), ")"))
    )


def evidence(e: dict[str, Column]) -> Column:
    """The facts of an event as a list of sentences; those that do not apply are left out."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = [
        text("Motion score: ", fixed(e["peak"], 2), " (peak), ", fixed(e["mean"], 2), " (mean)"),
        text("Observability: ", fixed(e["seen"], 2)),
        text("Frames analyzed: ", e["frames"]),
        F.when(e["persons"] > 0, text("Person tracks detected: ", e["persons"])),
        F.when(e["phone"], F.lit("Cell phone detected in frame")),
        F.when(e["paper"], F.lit("Paper/book detected in frame")),
        F.when(e["camera_share"] > 0.3, text("Possible camera motion: ", fixed(e["camera_share"] * 100, 1), "% of frames")),
        F.when(e["character"] == "sudden", text("Sudden onset detected (jerk saliency: ", fixed(e["jerk"], 2), ") — abrupt, non-periodic motion rather than gradual movement")),
    ]
    return F.array_compact(F.array(*lines))


def api_events(events: DataFrame) -> DataFrame:
    """Events in the interface's contract.

    ``events`` has event_id, video_id, start, end, peak, mean, seen, camera_share, frames, persons, phone, paper,
    character, jerk, track_id and clip.
    """
    e = {c: F.col(c) for c in events.columns}
    return events.select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("id"), "video_id", "start", "end", (F.col("end") - F.col("start")).alias("duration"), F.col("peak").alias("motion_score"),
        F.col("camera_share").alias("camera_shake"), priority(e["phone"], e["peak"], e["persons"]).alias("priority"), event_kind(e["phone"], e["paper"], e["persons"], e["camera_share"]).alias("type"),
        description(e["phone"], e["persons"], e["peak"], e["seen"]).alias("description"), F.coalesce(F.col("track_id").cast("string"), F.lit("N/A")).alias("track_id"),
        F.coalesce("clip", F.lit("")).alias("clip_url"), F.when(e["phone"], "person with phone").otherwise("person").alias("object"), F.col("mean").alias("confidence"),
        F.col("seen").alias("observability"), (F.lit(1.0) - F.col("seen")).alias("lighting"), evidence(e).alias("evidence"), F.col("persons").alias("person_count"),
    )


def video_quality(events: DataFrame) -> DataFrame:
    """Means of observability and camera shake over a video's events; 0 without events."""
    return events.groupBy("video_id").agg(F.coalesce(F.avg("seen"), F.lit(0.0)).alias("observability"), F.coalesce(F.avg("camera_share"), F.lit(0.0)).alias("camera_shake"), F.count("event_id").alias("events"))


def trusted_shake(quality: DataFrame, discount: float = 0.3) -> DataFrame:
    """Shake counts for the flag only where it was measured beside the moving regions (``mode`` masked).

    Elsewhere its score is discounted for observability.  ``quality`` has flow_flag, shake_flag, mode, shake and inliers.
    """
    trusted = F.col("mode") == "masked"
    score = F.col("shake") * F.col("inliers")
    return quality.withColumns({"trusted": F.col("shake_flag") & trusted, "shake_score": score, "shake_for_q": score * F.when(trusted, 1.0).otherwise(discount), "camera_motion": F.col("flow_flag") | (F.col("shake_flag") & trusted)})


def quality_summary(quality: DataFrame, key: str = "video_id") -> DataFrame:
    """How often each source flagged camera motion, how far shake was trusted, and in which modes it was measured."""
    flow, shake = F.col("flow_flag"), F.col("shake_flag")
    count = {"flow_only": flow & ~shake, "shake_only": shake & ~flow, "both": flow & shake, "raw_shake": shake, "trusted_shake": F.col("trusted"), "untrusted_shake": shake & ~F.col("trusted"), "camera_motion_frames": F.col("camera_motion")}
    modes = {m: F.col("mode") == m for m in ("masked", "unmasked_fallback", "cold_start")}
    out = quality.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), *[F.count_if(c).alias(k) for k, c in {**count, **modes}.items()])
    return out.withColumn("camera_motion_pct", F.round(100 * F.col("camera_motion_frames") / F.greatest(F.col("frames"), F.lit(1)), 1))


def spread(df: DataFrame, key: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Least, largest and median value of each column."""
    ends = df.groupBy(key).agg(*[F.round(f(c), digits).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    middle = exact_percentiles(df, [key], {f"median_{c}": (c, 0.5) for c in columns})
    return ends.join(middle.withColumns({f"median_{c}": F.round(f"median_{c}", digits) for c in columns}), key)


def mask_cleanup(masks: DataFrame, key: str = "video_id") -> DataFrame:
    """Foreground pixels before and after cleaning, and the mean shares of pixels lost (noise) or won (gaps), in percent.

    ``masks`` has before_px and after_px.
    """
    share = lambda more, less: F.round(F.when(F.col("before_px") > 0, F.greatest(F.lit(0.0), (F.col(more) - F.col(less)) / F.col("before_px")) * 100).otherwise(0.0), 2)
    return masks.groupBy(key).agg(
        F.count(F.lit(1)).alias("masks"), F.sum("before_px").alias("before_px"), F.sum("after_px").alias("after_px"),
        F.round(F.avg(share("before_px", "after_px")), 2).alias("noise_removed_pct"), F.round(F.avg(share("after_px", "before_px")), 2).alias("gaps_filled_pct"),
    )


def tiles(events: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: videos, events, high priority ones, findings that are shown, reviewed ones and their share in percent."""
    e = events.agg(F.count_distinct("video_id").alias("videos"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("priority") == "high").alias("high_priority"))
    f = findings.agg(F.count_if(~F.coalesce("suppressed", F.lit(False))).alias("findings"))
    v = verdicts.agg(F.count_distinct("key").alias("reviewed"))
    # three single rows
    out = e.join(F.broadcast(f)).join(F.broadcast(v))
    return out.withColumn("reviewed_pct", F.when(F.col("findings") > 0, math_round(F.col("reviewed") / F.col("findings") * 100)).otherwise(0).cast("bigint"))


def events_with_detections(events: DataFrame, detections: DataFrame) -> DataFrame:
    """(video_id, events, with_detections)."""
    seen = detections.select("event_id").distinct().withColumn("_seen", F.lit(True))
    return events.join(seen, "event_id", "left").groupBy("video_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("_seen")).alias("with_detections"))


def event_regions(frames: DataFrame, rois: DataFrame) -> DataFrame:
    """(event_id, frames, regions, sources): the regions of all frames of each event, in order of frame and number."""
    j = frames.select("event_id", "frame_idx").join(rois, "frame_idx", "left")
    return j.groupBy("event_id").agg(F.count_distinct("frame_idx").alias("frames"), F.count("roi_id").alias("regions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("roi_id").isNotNull(), F.struct("frame_idx", "roi_id", "x1", "y1")))), lambda s: s["roi_id"].cast("string")), ",").alias("numbers"))


def first_seen(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """(keys, values): the distinct values of each key in the order in which they first occur."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda s: s[value]).alias("values"))


def by_position(rows: DataFrame, sources: DataFrame, keys: list[str], order: list[str], source: str) -> DataFrame:
    """``rows`` with ``source`` of the row at the same place of ``sources``, each in its own order; null past its end."""
    at = F.row_number().over(ordered(keys, *order)).alias("_at")
    return rows.select("*", at).join(sources.select(*keys, source, at), [*keys, "_at"], "left").drop("_at")


def invalid_frame(channels: Column, size: Column, total: Column) -> Column:
    """Why a decoded frame cannot be used: missing, empty, channels or blank; null if it can."""
    return F.when(size.isNull(), "missing").when(size <= 0, "empty").when(F.coalesce(channels, F.lit(0)) != 3, "channels").when(total == 0, "blank")


def fleet_search(sites: DataFrame, text: str = "", only_problems: bool = False, limit: int = 30) -> DataFrame:
    """Sites whose name has the text, with problems if asked for; worst first, then by name, ``limit`` of them at most."""
    hit = F.contains(F.lower("site"), F.lit(text.strip().lower())) if text.strip() else F.lit(True)
    rows = sites.where(hit & (F.col("problems") > 0)) if only_problems else sites.where(hit)
    return rows.orderBy("severity", "site").limit(limit)
