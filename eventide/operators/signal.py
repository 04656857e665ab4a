"""Frame signals: self-calibrated scores, observability and their product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, min_max, observability
from . import scans
from .quantiles import exact_percentiles

WEIGHTS = {"raw_diff": 0.35, "raw_bg": 0.35, "raw_flow": 0.30}


def percentile_normalised(frames: DataFrame, columns: list[str], keys: list[str] | None = None, lo: float = 0.05, hi: float = 0.95, least_rows: int = 4) -> DataFrame:
    """Each column scaled by its own percentiles within a video, as ``norm_<name>``; 0 for short or flat videos.

    The bounds are one row per video and are joined back.
    """
    keys = keys or ["video_id"]
    bounds = exact_percentiles(frames, keys, {f"_{end}_{c}": (c, p) for c in columns for end, p in (("lo", lo), ("hi", hi))})
    joined = frames.join(bounds.join(frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys), keys)
    for c in columns:
        value = min_max(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
        joined = joined.withColumn("norm_" + c.removeprefix("raw_"), F.when(F.col("_rows") >= least_rows, value).otherwise(F.lit(0.0)))
    return joined.drop("_rows", *[f"_{end}_{c}" for c in columns for end in ("lo", "hi")])


def ensemble(frames: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``score``: the weighted sum of the normalised signals."""
    weights = weights or WEIGHTS
    if abs(sum(weights.values()) - 1) > 1e-3:
        raise ValueError("weights must add up to 1")
    frames = percentile_normalised(frames, list(weights))
    total = sum((F.col("norm_" + c.removeprefix("raw_")) * w for c, w in weights.items()), F.lit(0.0))
    return frames.withColumn("score", F.round(total, 6))


def by_time(frames: DataFrame) -> scans.Series:
    """Frames in the order of their videos, in stretches that all tasks share."""
    return scans.series(frames, ["video_id"], ["t", "frame_idx"])


def warm_up(frames: DataFrame, column: str = "raw_bg", rows: int = 10) -> DataFrame:
    """The column set to 0 in a video's first frames, while a background model settles."""
    counted = scans.scanned(by_time(frames), row=scans.number()).frame()
    return counted.withColumn(column, F.when(F.col("row") <= rows, F.lit(0.0)).otherwise(F.col(column)))


def running_min_max(frames: DataFrame, column: str) -> DataFrame:
    """Adds ``running``: the value between the least and the largest so far."""
    s = scans.scanned(by_time(frames), _least=scans.least(F.col(column)), _largest=scans.largest(F.col(column)))
    return s.frame().withColumn("running", min_max(F.col(column), F.col("_least"), F.col("_largest"))).drop("_least", "_largest")


def brightness_jump(frames: DataFrame, column: str, window: int = 10) -> DataFrame:
    """Adds ``jump``: largest minus least value of the last frames; 0 for a single one."""
    s = scans.scanned(by_time(frames), _lo=scans.least(F.col(column), rows=window), _hi=scans.largest(F.col(column), rows=window))
    return s.frame().withColumn("jump", F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def lag_difference(frames: DataFrame, column: str, k: int = 2) -> DataFrame:
    """Adds ``difference``: |x_t - x_(t-k)|; 0 for the first k frames."""
    s = scans.scanned(by_time(frames), _ago=scans.ago(F.col(column), k))
    return s.frame().withColumn("difference", F.coalesce(F.abs(F.col(column) - F.col("_ago")), F.lit(0.0))).drop("_ago")


def held(frames: DataFrame, columns: list[str], stride: int = 3) -> DataFrame:
    """Columns taken on every ``stride``-th frame and held until the next."""
    s = scans.scanned(by_time(frames), _n=scans.number())
    taken = (F.col("_n") - 1) % stride == 0
    return scans.scanned(s, **{c: scans.last(F.when(taken, F.col(c))) for c in columns}).frame().drop("_n")


def evidence_product(motion: DataFrame, quality: DataFrame) -> DataFrame:
    """Adds q, camera flag and ``s_final`` = evidence x observability; frames without quality count as clear."""
    jumped = brightness_jump(quality.join(motion.select("video_id", "frame_idx", "t"), ["video_id", "frame_idx"]), "brightness")
    q = jumped.select("video_id", "frame_idx", observability(F.col("shake"), F.col("blur"), F.col("jump")).alias("q"), "flag")
    joined = motion.join(q, ["video_id", "frame_idx"], "left")
    return joined.withColumns({"matched": F.col("q").isNotNull(), "q": F.coalesce("q", F.lit(1.0)), "flag": F.coalesce("flag", F.lit(0))}).withColumn("s_final", clamp01(F.col("score") * F.col("q")))
