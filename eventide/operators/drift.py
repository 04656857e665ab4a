"""Camera profiles over sessions: folding, drift and fleet triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import numbered_globally


#: How much each verdict undermines evidence, worst first.
SEVERITY = {"unusable": 0, "camera_moved": 1, "scene_changed": 2, "no_baseline": 3, "stable": 4}


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up on the double itself, so that any engine gives the same bits for a tie."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + F.lit(0.5)) / scale


def folded(profile: DataFrame, session: DataFrame) -> DataFrame:
    """(camera, region, mu, sigma, samples): a profile with a session's regions pooled in.

    Means are weighted by samples and variances pooled; the variance has a floor of 1e-6; 0 samples count
    as 1; regions of one side only are copied.
    """
    p = profile.select("camera", "region", F.col("mu").alias("m0"), F.col("sigma").alias("s0"), F.greatest(F.lit(1), "samples").alias("n0"))
    s = session.select("camera", "region", F.col("mu").alias("m1"), F.col("sigma").alias("s1"), F.greatest(F.lit(1), "samples").alias("n1"))
    j = p.join(s, ["camera", "region"], "full")
    n = F.col("n0") + F.col("n1")
    mu = (F.col("m0") * F.col("n0") + F.col("m1") * F.col("n1")) / n
    var = (F.col("n0") * (F.pow("s0", F.lit(2)) + F.pow(F.col("m0") - mu, F.lit(2))) + F.col("n1") * (F.pow("s1", F.lit(2)) + F.pow(F.col("m1") - mu, F.lit(2)))) / n
    one = lambda both, a, b: F.when(F.col("n0").isNull(), F.col(b)).when(F.col("n1").isNull(), F.col(a)).otherwise(both)
    return j.select("camera", "region", half_up(one(mu, "m0", "m1"), 6).alias("mu"), half_up(one(F.sqrt(F.greatest(F.lit(1e-6), var)), "s0", "s1"), 6).alias("sigma"), one(n, "n0", "n1").cast("bigint").alias("samples"))


def fold_guarded(profile: DataFrame, session: DataFrame, reports: DataFrame) -> DataFrame:
    """``folded``, but for cameras that moved or cannot be judged: their profile stays as it is.

    Folding those in would make the deviation that was just reported the new normal.
    """
    allowed = reports.where(~F.col("verdict").isin("camera_moved", "unusable")).select("camera")
    return folded(profile, session.join(allowed, "camera", "left_semi"))


def shifts(profile: DataFrame, session: DataFrame) -> DataFrame:
    """(camera, region, shift): how many stored sigmas a region's mean moved."""
    p = profile.select("camera", "region", F.col("mu").alias("was"), "sigma")
    return p.join(session.select("camera", "region", F.col("mu").alias("now")), ["camera", "region"]).withColumn("shift", F.round(F.abs(F.col("now") - F.col("was")) / F.greatest("sigma", F.lit(1e-3)), 2))


def drift(cameras: DataFrame, profile: DataFrame, session: DataFrame, tolerance: float = 3.0, share: float = 0.5, least_regions: int = 3) -> DataFrame:
    """(camera, verdict, regions_shifted, regions_compared, peak_shift) of each camera.

    ``cameras`` has (camera, comparable): whether grid and resolution are those of the profile.
    """
    s = shifts(profile, session)
    agg = s.groupBy("camera").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("shift") > tolerance).alias("shifted"), F.max("shift").alias("peak"))
    known = profile.select("camera").distinct().withColumn("known", F.lit(True))
    j = cameras.join(known, "camera", "left").join(agg, "camera", "left")
    moved = (F.col("shifted") / F.col("compared") >= share) & (F.col("shifted") >= least_regions)
    verdict = F.when(F.col("known").isNull(), "no_baseline").when(~F.col("comparable") | F.col("compared").isNull(), "unusable").when(F.col("shifted") == 0, "stable").when(moved, "camera_moved").otherwise("scene_changed")
    usable = verdict.isin("stable", "camera_moved", "scene_changed")
    return j.select("camera", verdict.alias("verdict"), F.when(usable, F.col("shifted")).otherwise(0).alias("regions_shifted"), F.when(usable, F.col("compared")).otherwise(0).alias("regions_compared"), F.when(usable, F.col("peak")).otherwise(0.0).alias("peak_shift"))


def worst_regions(profile: DataFrame, session: DataFrame, k: int = 3) -> DataFrame:
    """The k regions of each camera that moved most."""
    s = shifts(profile, session)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("shift"), "region"))).where(F.col("rank") <= k).select("camera", "rank", "region", "shift")


def summary(profile: DataFrame, session: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(camera, compared, shifted, share, peak, worst): how many regions moved, by how much, and the three that moved most."""
    s = shifts(profile, session)
    order = F.array_sort(F.collect_list(F.struct((-F.col("shift")).alias("less"), F.col("region").alias("region"))))
    moved = F.count_if(F.col("shift") > tolerance)
    worst = F.array_join(F.transform(F.slice(order, 1, 3), lambda x: x["region"]), ",")  # a camera has a dozen regions
    return s.groupBy("camera").agg(F.count(F.lit(1)).alias("compared"), moved.alias("shifted"), (moved / F.count(F.lit(1))).alias("share"), F.max("shift").alias("peak"), worst.alias("worst"))


def severity(verdict: str = "verdict") -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col(verdict)]


def fleet_order(reports: DataFrame) -> DataFrame:
    """Reports with the place of each in the queue: worst verdict first, then largest shift."""
    return numbered_globally(reports.withColumn("severity", severity()), "place", F.col("severity"), F.desc("peak_shift"), F.col("camera"))


def rollup(reports: DataFrame, key: str) -> DataFrame:
    """Per site: cameras, the worst verdict, and how many cameras need attention."""
    r = reports.withColumn("severity", severity())
    return r.groupBy(key).agg(F.count(F.lit(1)).alias("cameras"), F.min_by("verdict", "severity").alias("worst"), F.count_if(~F.col("verdict").isin("stable", "no_baseline")).alias("problems"), F.max("peak_shift").alias("peak_shift"))


