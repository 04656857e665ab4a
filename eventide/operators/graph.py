"""Connected components of an edge table, by large-star and small-star rounds.

Both kinds of round need only the least neighbour of each node, which is a partial
aggregation, and a join back to the edges that AQE may split at a hot node; no
neighbour list is ever gathered.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..sources.storage import drop_stored, stored
from .spatial import box_join


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` with the least node it is connected to.

    Self-loops are ignored.  Raises if it has not settled after ``max_rounds``.
    """
    pairs = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi > lo").distinct()
    now = stored(pairs, "edges")
    seen = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("root"))
        large = both.join(least, "hi").where("lo > hi and root < lo").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        large = large.distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(low, "hi").where("lo <> root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        after = stored(small.unionByName(low.select("hi", F.col("root").alias("lo"))).where("hi > lo").distinct(), "edges")
        state = _state(after)
        drop_stored(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free hash of the edges, to tell when nothing changes."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def evidence_edges(events: DataFrame, sightings: DataFrame, seconds: float = 300.0, least_iou: float = 0.3) -> DataFrame:
    """(video_id, a, b, reason): links between a video's events that show the same subject, or the same place soon after.

    Every event of a subject is linked to the subject's least event, which gives the same groups and reasons as all
    pairs would, in as many links as sightings.  Pairs by place meet in a cell of (video, time bucket); those that share a
    subject are no links by place.
    """
    seen = sightings.select("video_id", "track_id", "event_id").distinct()
    least = seen.groupBy("video_id", "track_id").agg(F.min("event_id").alias("a"))
    by_track = seen.withColumnRenamed("event_id", "b").join(least, ["video_id", "track_id"]).where("a < b").select("video_id", "a", "b", F.lit("same_subject").alias("reason"))

    # an event's subjects are few, so they go along as an array
    subjects = seen.groupBy("event_id").agg(F.collect_set("track_id").alias("tracks"))
    known = events.join(subjects, "event_id", "left").withColumn("tracks", F.coalesce("tracks", F.array().cast(subjects.schema["tracks"].dataType)))
    side = lambda k, s: known.select("video_id", F.col("event_id").alias(k), F.col("start").alias(s), F.col("tracks").alias(f"{k}_tracks"), *[F.col(e).alias(f"{k}_{e}") for e in ("x1", "y1", "x2", "y2")])
    one = side("a", "s1").withColumn("bucket", F.explode(F.array(*[F.floor(F.col("s1") / seconds) + i for i in (-1, 0, 1)])))
    two = side("b", "s2").withColumn("bucket", F.floor(F.col("s2") / seconds))
    near = box_join(one, two, ["video_id", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("s1") - F.col("s2")) < seconds) & (iou(box("a_"), box("b_")) > least_iou) & ~F.arrays_overlap("a_tracks", "b_tracks"))
    by_place = near.select("video_id", "a", "b", F.lit("same_place").alias("reason"))
    return by_track.unionByName(by_place).distinct()


def shared_subjects(members: DataFrame, sightings: DataFrame) -> DataFrame:
    """(root, track_id, events): subjects that more than one event of a group shows; ``members`` has (event_id, root)."""
    seen = sightings.select("event_id", "track_id").distinct().join(members.select("event_id", "root"), "event_id")
    return seen.groupBy("root", "track_id").agg(F.count(F.lit(1)).alias("events")).where("events > 1")


def evidence_groups(edges: DataFrame, events: DataFrame, sightings: DataFrame) -> DataFrame:
    """(video_id, root, events, span, reasons, shared, place): groups of two or more linked events.

    ``shared`` counts the subjects of more than one event; ``place`` is the group's in its video, largest first.
    """
    edges = stored(edges, "evidence-links")  # read for the groups and for their reasons
    roots = stored(components(edges.select("a", "b")), "evidence-roots")
    members = events.join(roots, events["event_id"] == roots["node"])
    groups = members.groupBy("video_id", "root").agg(F.count(F.lit(1)).alias("events"), F.round(F.max("start") - F.min("start"), 2).alias("span"))
    why = edges.join(roots, edges["a"] == roots["node"]).groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    shared = shared_subjects(members, sightings).groupBy("root").agg(F.count(F.lit(1)).alias("shared"))
    out = groups.join(why, "root").join(shared, "root", "left").fillna({"shared": 0})
    return out.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("events"), "root")))
