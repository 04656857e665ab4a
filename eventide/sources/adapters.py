"""The engine's input tables, derived from the synthetic star schema.

The tables hold no video, so orders, line items and events stand in for frames, boxes,
tracks and findings; thresholds are scaled to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import go_round


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """A timestamp as seconds since 1970, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, t, raw_diff, raw_bg, raw_flow): one row per frame."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), seconds(F.col("ts")).alias("t"), F.col("value").alias("raw_diff"), F.col("k").cast("double").alias("raw_bg"), (F.col("value") * (1 + F.col("k") % 7) / 7.0).alias("raw_flow"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, shake, blur, brightness, flag) for the frames whose k is not a multiple of 9."""
    s = signal(spark, sf_dir).where("cast(raw_bg as int) % 9 <> 0")
    k = F.col("raw_bg").cast("int")
    return s.select("video_id", "frame_idx", (k % 25).cast("double").alias("shake"), (F.col("raw_diff") % 100).alias("blur"), (F.col("raw_diff") % 40).alias("brightness"), (k % 10 == 0).cast("int").alias("flag"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, roi_id, x1, y1, x2, y2, cls, conf, track_id, filled): several boxes a frame."""
    return as_boxes(table(spark, sf_dir, "lineitem"))


def as_boxes(lines: DataFrame, *more: str) -> DataFrame:
    """Line items as boxes, with columns of theirs that go along."""
    x1, y1 = (F.col("l_partkey") * 37) % 600, (F.col("l_suppkey") * 53) % 320
    w, h = (10 + F.col("l_quantity")).cast("long"), (12 + F.col("l_linenumber") * 9).cast("long")
    cls = F.when(F.col("l_returnflag") == "A", "cell phone").when(F.col("l_returnflag") == "N", "person").otherwise("book")
    return lines.select(
        F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").alias("roi_id"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"), cls.alias("cls"), F.round(F.col("l_discount") * 9, 4).alias("conf"), F.col("l_suppkey").alias("track_id"), F.col("l_tax").alias("filled"), F.col("l_partkey").alias("source_id"), *more,
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with the time of their frame, and the group (customer) that they belong to."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("video_id"), seconds(F.col("o_orderdate")).alias("t"))
    # line items are joined as they are, as boxes have more columns that would have to be moved
    return as_boxes(table(spark, sf_dir, "lineitem").join(o, "l_orderkey"), "video_id", "t")


def keypoints(boxes: DataFrame) -> DataFrame:
    """Persons' boxes (with video_id, t and box_id) as poses: (video_id, track_id, frame_idx, t, box_id, box, joints as x, y and c)."""
    video, track, p = F.col("video_id") % 100, F.col("track_id") % 3, F.col("source_id")
    wide = (20 + 60 * ((video * 3 + track) % 10)).cast("double")
    mid, top = (F.col("x1") + F.col("x2")) / 2.0, F.col("y1") + F.lit(10.0)
    sure = lambda x: (4 + x % 7) / 10.0
    joints = {
        "nose": (mid - wide / 2 + wide * (p * 7 % 100) / 100.0, top, sure(p * 5)), "ls": (mid - wide / 2, top, F.lit(0.9)), "rs": (mid + wide / 2, top + 2, sure(F.col("roi_id"))),
        "lw": (mid - wide / 2, top + 1 - wide * (p * 11 % 100 - 40) / 100.0, sure(p)), "rw": (mid + wide / 2, top + 1 - wide * (p * 13 % 100 - 40) / 100.0, sure(p * 3)),
        "lh": (mid, F.col("y2") - F.lit(5.0), sure(p * 2)), "rh": (mid, F.col("y2") - F.lit(3.0), F.lit(0.6)),
    }
    parts = [c.alias(f"{j}_{a}") for j, xyc in joints.items() for a, c in zip("xyc", xyc, strict=True)]
    return boxes.where("cls = 'person'").select(video.alias("video_id"), track.alias("track_id"), "frame_idx", "t", "box_id", "x1", "y1", "x2", "y2", *parts)


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, type, confidence, verdict): findings with what a reviewer made of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"), go_round(F.col("n_chars") / 20000.0, 4).alias("confidence"), "source")
    verdict = F.when(F.col("quality") == 1, "confirmed").otherwise("dismissed")
    return d.join(table(spark, sf_dir, "labels").withColumn("verdict", verdict), "doc_id")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(camera, session, region, frame_idx, activity): regions are event types, sessions are halves of the month."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("camera"), F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("session"), F.col("event_type").alias("region"), F.col("event_id").alias("frame_idx"), F.col("value").alias("activity"))


def event_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, video_id, start, motion, camera_share, status, persons, phones, papers, objects): orders as events."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("video_id"), seconds(F.col("o_orderdate")).alias("start"), go_round(F.col("o_totalprice") / 500000, 4).alias("motion"), ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("camera_share"), F.col("o_orderstatus").alias("status"))
    b = boxes(spark, sf_dir).groupBy(F.col("frame_idx").alias("event_id")).agg(F.count_if(F.col("cls") == "person").alias("persons"), F.count_if((F.col("cls") == "cell phone") & (F.col("conf") >= 0.35)).alias("phones"), F.count_if((F.col("cls") == "book") & (F.col("conf") >= 0.35)).alias("papers"), F.round(F.max(F.when(F.col("cls") != "person", F.col("conf"))), 3).alias("object_score"))
    return o.join(b, "event_id", "left").fillna({"persons": 0, "phones": 0, "papers": 0, "object_score": 0.0})


def ledger_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, seq, statement_hash): each conversation is a log of statements."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), (F.col("turn") + 1).cast("int").alias("seq"), F.sha2(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("statement_hash"))


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "signal": """signal as (select user_id as video_id, event_id as frame_idx, epoch_us(ts) / 1000000.0::double as t, value as raw_diff, k::double as raw_bg, value * (1 + k % 7) / 7.0::double as raw_flow, k
        from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))""",
    "quality": """quality as (select video_id, frame_idx, (k % 25)::double as shake, raw_diff % 100 as blur, raw_diff % 40 as brightness, case when k % 10 = 0 then 1 else 0 end as flag from signal where k % 9 <> 0)""",
    "boxes": """boxes as (select l_orderkey as frame_idx, l_linenumber as roi_id, (l_partkey * 37) % 600 as x1, (l_suppkey * 53) % 320 as y1, (l_partkey * 37) % 600 + cast(10 + l_quantity as bigint) as x2, (l_suppkey * 53) % 320 + 12 + l_linenumber * 9 as y2,
        case l_returnflag when 'A' then 'cell phone' when 'N' then 'person' else 'book' end as cls, round(l_discount * 9, 4) as conf, l_suppkey as track_id, l_tax as filled, l_partkey as source_id from lineitem)""",
    "tracks": """tracks as (select b.*, o_custkey as video_id, epoch_us(o_orderdate) / 1000000.0::double as t from boxes b join orders on o_orderkey = frame_idx)""",
    "review": """review as (select doc_id, lang as type, round(n_chars / 20000.0::double, 4) as confidence, source, quality, toxic, case when quality = 1 then 'confirmed' else 'dismissed' end as verdict from documents join labels using (doc_id))""",
    "activity": """activity as (select user_id as camera, case when day(ts) <= 15 then 1 else 2 end as session, event_type as region, event_id as frame_idx, value as activity from events)""",
    "event_set": """event_set as (select o_orderkey as event_id, o_custkey as video_id, epoch_us(o_orderdate) / 1000000.0::double as start, round(o_totalprice / 500000, 4) as motion, (o_orderkey * 7919 % 1000) / 1000.0::double as camera_share, o_orderstatus as status,
        coalesce(persons, 0) as persons, coalesce(phones, 0) as phones, coalesce(papers, 0) as papers, coalesce(object_score, 0) as object_score
        from orders left join (select frame_idx, count(*) filter (cls = 'person') as persons, count(*) filter (cls = 'cell phone' and conf >= 0.35) as phones, count(*) filter (cls = 'book' and conf >= 0.35) as papers, round(max(case when cls <> 'person' then conf end), 3) as object_score from boxes group by 1) on frame_idx = o_orderkey)""",
    "ledger": """ledger as (select conv_id as job_id, (turn + 1)::int as seq, sha256(coalesce(role, '') || '|' || coalesce(text, '')) as statement_hash from conversations)""",
}


def ctes(*names: str) -> str:
    """A WITH clause of the named tables."""
    return "with recursive " + ",\n".join(SQL[n] for n in names)
