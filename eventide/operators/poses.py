"""What keypoints tell of a pose: head yaw, wrist lift, torso length; and how far a subject travelled.

A pose has (x, y, c) of each joint as columns, as ``nose_x``; joints that are seen with less than
``LEAST_CONFIDENCE`` count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, centre, confident, head_yaw, torso_length, wrist_lift
from .quantiles import exact_percentiles
from .windows import latest, ordered

LEAST_CONFIDENCE = 0.5
#: Shoulder widths that a subject may travel before its turns and raises count as walking.
MOST_LOCOMOTION = 2.0
ORDER = ["t", "frame_idx", "box_id"]


def joint(name: str, axis: str) -> Column:
    return confident(F.col(f"{name}_{axis}"), F.col(f"{name}_c"), LEAST_CONFIDENCE)


def measured(poses: DataFrame) -> DataFrame:
    """Poses with yaw, lift, lift_conf, shoulder and torso; null where a joint that is needed is missing."""
    left, right = joint("ls", "x"), joint("rs", "x")
    line = (joint("ls", "y") + joint("rs", "y")) / 2
    shoulder = F.abs(left - right)
    raised = wrist_lift(line, shoulder, (joint("lw", "y"), F.col("lw_c")), (joint("rw", "y"), F.col("rw_c")))
    return poses.withColumns({"yaw": head_yaw(joint("nose", "x"), left, right), "shoulder": shoulder, "_raised": raised, "torso": torso_length(line, joint("lh", "y"), joint("rh", "y"))}).withColumns({"lift": F.col("_raised.lift"), "lift_conf": F.col("_raised.conf")}).drop("_raised")


def hands(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_idx, track_id, hx, hy, shoulder): the wrists that are seen, of a track's first pose in a frame.

    Without both shoulders, a pixel apart at least, there is no measure of how near a hand is, and none counts.
    """
    wrists = F.array(*[F.struct(joint(w, "x").alias("hx"), joint(w, "y").alias("hy")) for w in ("lw", "rw")])
    # only what is asked for goes through the shuffle
    narrow = poses.select(*keys, "frame_idx", "track_id", "box_id", F.abs(joint("ls", "x") - joint("rs", "x")).alias("shoulder"), wrists.alias("_wrists"))
    first = latest(narrow, [*keys, "track_id", "frame_idx"], "box_id").where("shoulder >= 1")
    return first.select(*keys, "frame_idx", "track_id", "shoulder", F.inline("_wrists")).where("hx is not null and hy is not null")


def posture(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, samples, base, shoulder, travelled) of each subject, from measured poses.

    ``base`` is the median yaw of ``samples`` poses; ``travelled`` the span of box centres in median
    shoulder widths, null with fewer than two boxes, no shoulders or shoulders under a pixel.
    """
    cx, cy = centre(box())
    middle = exact_percentiles(poses, keys, {"base": ("yaw", 0.5), "shoulder": ("shoulder", 0.5)})
    span = F.hypot(F.max(cx) - F.min(cx), F.max(cy) - F.min(cy))
    seen = poses.groupBy(*keys).agg(F.count("yaw").alias("samples"), F.count(cx).alias("_boxes"), span.alias("_span")).join(middle, keys)
    return seen.withColumn("travelled", F.when((F.col("_boxes") >= 2) & (F.col("shoulder") >= 1), F.col("_span") / F.col("shoulder"))).drop("_boxes", "_span")


def anchored() -> Column:
    """Whether a subject stayed at its place, or nothing is known of how far it went."""
    return F.coalesce(F.col("travelled") <= MOST_LOCOMOTION, F.lit(True))


def sustained(frames: DataFrame, flag: Column, value: Column, keys: list[str], least: int, order: list[str], at_peak: list[str], at_start: list[str] | None = None) -> DataFrame:
    """Runs of at least ``least`` rows in a row that the flag marks; a null flag ends a run.

    (keys, frames, start, end, start_frame, peak, peak_frame, at_peak..., at_start..., open): the first of equal peaks counts;
    ``open`` tells that the run goes on to the subject's last row.
    """
    w = ordered(keys, *order)
    f = frames.withColumns({"_flag": F.coalesce(flag, F.lit(False)), "_value": value, "_n": F.row_number().over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    f = f.withColumn("_run", F.col("_n") - F.row_number().over(ordered([*keys, "_flag"], "_n"))).where("_flag")
    best = F.struct("_value", -F.col("_n"))
    runs = f.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("frames"), F.min_by("t", "_n").alias("start"), F.max_by("t", "_n").alias("end"), F.min_by("frame_idx", "_n").alias("start_frame"),
        F.max("_value").alias("peak"), F.max_by("frame_idx", best).alias("peak_frame"), *[F.max_by(c, best).alias(c) for c in at_peak], *[F.min_by(c, "_n").alias(c) for c in at_start or []], F.bool_or("_last").alias("open"),
    )
    return runs.where(F.col("frames") >= least).drop("_run")


def value_at(poses: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, frame_idx, value): the first value that is known in each frame of a subject."""
    return poses.where(F.col(value).isNotNull()).groupBy(*keys, "frame_idx").agg(F.min_by(value, F.struct(*order)).alias(value))


def head_turns(poses: DataFrame, keys: list[str], deviation: float = 0.35, absolute: float = 0.80, least: int = 5, samples: int = 4, postures: DataFrame | None = None) -> DataFrame:
    """Sustained looks away from a subject's own median yaw, of subjects that stayed at their place.

    The peak is the larger of deviation and yaw.  A turn is to the right if its first yaw is over the base;
    one that is still open at the subject's last pose is compared with 0 instead.  ``postures`` are those of ``poses``, if they are known.
    """
    still = (posture(poses, keys) if postures is None else postures).where((F.col("samples") >= samples) & anchored()).select(*keys, "base")
    frame = ordered([*keys, "base", "frame_idx"], *ORDER).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = poses.join(still, keys).withColumn("_first", F.first("yaw", ignorenulls=True).over(frame))  # as value_at, where the rows lie
    off, turn = F.abs(F.col("yaw") - F.col("base")), F.abs(F.col("yaw"))
    runs = sustained(p, (off > deviation) | (turn > absolute), F.greatest(off, turn), [*keys, "base"], least, ORDER, [], ["_first"])
    right = F.coalesce(F.col("_first"), F.lit(-1.0)) > F.when(F.col("open"), F.lit(0.0)).otherwise(F.col("base"))
    return runs.withColumns({"direction": F.when(right, "right").otherwise("left"), "confidence": F.round(F.least(F.lit(1.0), F.col("peak") / 1.2), 4)}).drop("_first")


def hand_raises(poses: DataFrame, keys: list[str], lift: float = 0.15, least: int = 3, postures: DataFrame | None = None) -> DataFrame:
    """The first sustained raise of a wrist of each subject that stayed at its place; confidence is that of the wrist at the peak."""
    still = (posture(poses, keys) if postures is None else postures).where(anchored()).select(*keys)
    runs = sustained(poses.join(still, keys), F.col("lift") > lift, F.col("lift"), keys, least, ORDER, ["lift_conf"])
    first = runs.withColumn("_n", F.row_number().over(ordered(keys, "start", "start_frame"))).where("_n = 1").drop("_n")
    return first.withColumn("confidence", F.least(F.lit(1.0), F.col("lift_conf"))).drop("lift_conf")
