"""Queries over scans, sinks and the order-bound series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box, centre
from ..operators import jerk, signal
from ..operators.windows import interval_join, numbered_globally
from ..sources import adapters, readers, sinks
from ..sources.adapters import ctes
from .signal_queries import _SCORED


def q_jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jerk.with_jerk(signal.ensemble(adapters.signal(spark, sf_dir)).select("video_id", "frame_idx", "t", "score")).select("video_id", "frame_idx", "jerk_score")


def q_heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = adapters.boxes(spark, sf_dir).withColumn("video_id", F.col("frame_idx") % 16)
    return sinks.heat_grid(b).withColumn("heat", F.round("heat", 6))


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = adapters.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return sinks.upserted(c, new, ["c_custkey"])


def q_reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    f = e.select((F.col("user_id") % 7).alias("job_id"), F.col("event_type").alias("type"), (F.col("event_id") % 500).alias("frame_idx"), "event_id")
    v = e.select((F.col("user_id") % 7).alias("job_id"), F.col("event_type").alias("type"), (F.col("event_id") % 500 + 250).alias("frame_idx"), "ts", F.when(F.col("value") > 10, "confirmed").otherwise("dismissed").alias("verdict"))
    return sinks.reattached(f, v)


def q_nested_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = centre(box())
    b = adapters.boxes(spark, sf_dir).withColumns({"video_id": F.col("frame_idx") % 16, "cx": x, "cy": y})
    return sinks.nested_by_frame(b, ["roi_id", "x1", "source_id", "y1"]).select("frame_idx", F.size("rois").alias("rois"), F.to_json("rois").alias("boxes"))


def q_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), (5.0 + F.col("p_size")).alias("fps"), (F.col("p_size") * 3).cast("bigint").alias("frame_count"))
    return readers.sampled_frames(v).groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.max("frame_idx").alias("last_frame"))


def q_window_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside a coarse scan's windows: stretches of time are met before times are compared."""
    o = adapters.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("video_id"), (adapters.seconds(F.col("o_orderdate")) % 2592000 + 1704067200).alias("start")).withColumn("end", F.col("start") + 7200)
    s = adapters.signal(spark, sf_dir)
    return interval_join(s, o, ["video_id"], "t", "start", "end", 7200.0, "left_semi").select("video_id", "frame_idx")


def q_job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs newest first, with their stored size and findings."""
    d = adapters.table(spark, sf_dir, "documents")
    stats = d.groupBy(F.col("source").alias("job_id")).agg(F.sum("n_chars").alias("size"), F.count_if(F.col("n_chars") >= 100).alias("findings"), F.max("doc_id").alias("newest"))
    return numbered_globally(stats, "place", F.desc("job_id"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

ORACLE_SQL = {
    "q_heat_grid": ctes("boxes") + """, c as (select frame_idx % 16 as video_id, unnest(range(x1 // 20, (x2 - 1) // 20 + 1)) as cx, y1, y2 from boxes), d as (select video_id, cx, unnest(range(y1 // 20, (y2 - 1) // 20 + 1)) as cy from c), h as (select video_id, cx, cy, count(*) as hits from d group by 1, 2, 3)
        select *, round(hits / (max(hits) over (partition by video_id))::double, 6) as heat from h""",
    "q_upsert": "with n as (select s_suppkey * 20 as c_custkey, s_name as c_name, s_acctbal as c_acctbal from supplier) select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from n) union all select * from n",
    "q_reattach": """with f as (select user_id % 7 as job_id, event_type as type, event_id % 500 as frame_idx, event_id, ts, value from events), v as (select job_id, type, frame_idx + 250 as frame_idx, arg_max(case when value > 10 then 'confirmed' else 'dismissed' end, ts) as verdict from f group by 1, 2, 3)
        select job_id, type, frame_idx, event_id, verdict from f left join v using (job_id, type, frame_idx)""",
    "q_nested_rois": ctes("boxes") + """ select frame_idx, count(*)::int as rois, '[' || string_agg('{"roi_id":' || roi_id || ',"x1":' || x1 || ',"source_id":' || source_id || ',"y1":' || y1 || '}', ',' order by roi_id, x1, source_id, y1) || ']' as boxes from boxes group by 1""",
    "q_sampled_frames": """with v as (select p_partkey as video_id, 5.0::double + p_size as fps, p_size * 3 as n from part), s as (select *, greatest(1, round_even(fps / least(5.0::double, fps), 0)::int) as stride from v where n > 0)
        select video_id, (n - 1) // stride + 1 as frames, ((n - 1) // stride) * stride as last_frame from s""",
    "q_window_pruned": ctes("signal") + """, w as (select o_custkey % 150 as video_id, (epoch_us(o_orderdate) / 1000000.0::double) % 2592000 + 1704067200 as s from orders)
        select video_id, frame_idx from signal f where exists (select 1 from w where w.video_id = f.video_id and t between s and s + 7200)""",
    "q_job_listing": "select source as job_id, sum(n_chars)::bigint as size, count(*) filter (n_chars >= 100) as findings, max(doc_id) as newest, row_number() over (order by source desc nulls last) as place from documents group by 1",
    "q_jerk": _SCORED + """,
    s as (select video_id, frame_idx, score, row_number() over (partition by video_id order by t, frame_idx) - 1 as j, count(*) over (partition by video_id) as n from scored),
    x as (select a.video_id, a.j as k, a.n, sum(b.score * cos(2 * pi() * ((a.j * b.j) % a.n) / a.n)) as re, -sum(b.score * sin(2 * pi() * ((a.j * b.j) % a.n) / a.n)) as im from s a join s b using (video_id) where a.n >= 8 group by 1, 2, 3),
    l as (select *, ln(sqrt(re * re + im * im) + 1e-8) as la from x),
    r as (select *, la - (la + coalesce(lag(la) over w, 0) + coalesce(lead(la) over w, 0)) / 3 as res, atan2(im, re) as phase from l window w as (partition by video_id order by k)),
    y as (select a.video_id, a.k as j, sum(exp(b.res) * cos(b.phase + 2 * pi() * ((a.k * b.k) % a.n) / a.n)) / any_value(a.n) as re, sum(exp(b.res) * sin(b.phase + 2 * pi() * ((a.k * b.k) % a.n) / a.n)) / any_value(a.n) as im from r a join r b using (video_id) group by 1, 2),
    g as (select d, exp(-(d * d) / 4.5::double) as g from range(-3, 4) t(d)),
    sm as (select a.video_id, a.j, sum((b.re * b.re + b.im * b.im) * g.g) / (select sum(g) from g) as v from y a join y b on a.video_id = b.video_id and b.j between a.j - 3 and a.j + 3 join g on g.d = b.j - a.j group by 1, 2),
    ends as (select video_id, min(v) as lo, max(v) as hi from sm group by 1)
    select s.video_id, s.frame_idx, round(case when hi is null or hi - lo <= 1e-9 then 0 else (v - lo) / (hi - lo) end, 6) as jerk_score from s left join sm using (video_id, j) left join ends using (video_id)""",
}
