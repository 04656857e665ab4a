"""Baselines of regions and what stands out from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import ordered

SIGMA_FLOOR = 1e-3


def baselines(activity: DataFrame, keys: list[str], frames: int = 150) -> DataFrame:
    """(keys, region, mu, sigma, samples) of the first frames of each region; sigma of the population, not under a floor."""
    n = F.row_number().over(ordered([*keys, "region"], "frame_idx"))
    first = activity.withColumn("_n", n).where(F.col("_n") <= frames)
    return first.groupBy(*keys, "region").agg(F.round(F.avg("activity"), 6).alias("mu"), F.round(F.greatest(F.lit(SIGMA_FLOOR), F.stddev_pop("activity")), 6).alias("sigma"), F.count(F.lit(1)).alias("samples"))


def anomalies(activity: DataFrame, base: DataFrame, keys: list[str], least: float = 3.0) -> DataFrame:
    """Frames whose activity is ``least`` sigmas over the region's mean."""
    z = (F.col("activity") - F.col("mu")) / (F.col("sigma") + 1e-6)
    return activity.join(base, [*keys, "region"]).withColumn("z", F.round(z, 4)).where(F.col("z") >= least)


def region_activity(rois: DataFrame, grid: DataFrame, cell_area: float) -> DataFrame:
    """Share of each cell that regions of interest cover; cells without any are 0."""
    total = rois.groupBy("video_id", "frame_idx", "region").agg(F.sum("area").alias("covered"))
    cells = rois.select("video_id", "frame_idx").distinct().crossJoin(F.broadcast(grid))  # the grid has a dozen cells
    return cells.join(total, ["video_id", "frame_idx", "region"], "left").select("video_id", "frame_idx", "region", (F.coalesce("covered", F.lit(0)) / cell_area).alias("activity"))


def strongest(findings: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with the z of the strongest anomaly at their frame and region; 0 without one."""
    best = found.groupBy(*keys, "frame_idx", "region").agg(F.max_by("z", F.abs(F.col("z"))).alias("region_z"))
    return findings.join(best, [*keys, "frame_idx", "region"], "left").fillna({"region_z": 0.0})
