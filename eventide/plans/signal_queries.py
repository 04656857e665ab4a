"""Queries over frame signals: normalisation, observability, segmentation, scan windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans
from ..operators import segment as seg
from ..operators import signal as sig
from ..sources.adapters import activity, ctes, quality, signal

#: Scaled to the series of the test data, whose frames are hours apart.
LIMITS = seg.Thresholds(start=0.30, end=0.15, min_duration=5400.0, merge_gap=3600.0, padding=10800.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.ensemble(signal(spark, sf_dir))


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.evidence_product(scored(spark, sf_dir), quality(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("video_id", "frame_idx", "t", (F.col("raw_bg") / 100).alias("activity"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).groupBy("video_id").agg(F.min("t").alias("origin"), (F.max("t") - F.min("t")).alias("length"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def q_percentile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir), "norm_diff", "norm_bg", "norm_flow").select("video_id", "frame_idx", "norm_diff", "norm_bg", "norm_flow", "score")


def q_running_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sig.running_min_max(signal(spark, sf_dir), "raw_diff"), "running").select("video_id", "frame_idx", "running")


def q_warmup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.warm_up(signal(spark, sf_dir)).select("video_id", "frame_idx", "row", "raw_bg")


def q_brightness_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sig.brightness_jump(signal(spark, sf_dir), "raw_diff"), "jump").select("video_id", "frame_idx", "jump")


def q_lag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sig.lag_difference(signal(spark, sf_dir), "raw_diff"), "difference").select("video_id", "frame_idx", "difference")


def q_shake_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.held(signal(spark, sf_dir), ["raw_bg"]).select("video_id", "frame_idx", "raw_bg")


def q_s_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(final(spark, sf_dir), "q", "s_final", digits=10).select("video_id", "frame_idx", "q", "flag", "matched", "s_final")


def q_q_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = final(spark, sf_dir).groupBy("video_id").agg(F.count_if("matched").alias("with_quality"), F.count_if(~F.col("matched")).alias("without"), F.sum("flag").alias("flagged"), F.round(F.avg("q"), 5).alias("mean_q"), F.round(F.min("q"), 5).alias("least_q"))
    return f


def q_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.latched(sig.by_time(scored(spark, sf_dir)), F.col("score"), LIMITS.start, LIMITS.end, "on_event").frame().select("video_id", "frame_idx", "on_event")


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = final(spark, sf_dir)
    return seg.segment(frames, LIMITS), frames


def q_segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(found(spark, sf_dir)[0], "start", "end", "unpadded_start", "unpadded_end", digits=3)


def q_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.event_statistics(*found(spark, sf_dir), tick=3600.0, digits=10)


def q_scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = seg.scan_windows(samples(spark, sf_dir), pad=3 * 3600.0, gap=1800.0, least=7 * 3600.0)
    return rounded(w, "start", "end", "threshold", digits=4).select("video_id", "window_id", "start", "end", "samples", "threshold")


def q_scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = seg.scan_windows(samples(spark, sf_dir), pad=3 * 3600.0, gap=1800.0, least=7 * 3600.0)
    return rounded(seg.coverage(w, videos(spark, sf_dir).select("video_id", F.col("length").alias("duration"))), "covered", "coverage", digits=4).select("video_id", "windows", "covered", "coverage")


def q_activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.activity_buckets(found(spark, sf_dir)[0].select("video_id", "start", "end"), videos(spark, sf_dir))


def q_hold_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each still is shown in a clip: until the next one, at least 0.04 s."""
    s = scans.scanned(sig.by_time(signal(spark, sf_dir)), nxt=scans.following(F.col("t"))).frame()
    return s.select("video_id", "frame_idx", F.round(F.greatest(F.lit(0.04), F.coalesce("nxt", "t") - F.col("t")), 5).alias("hold"))


def q_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of all videos as a single one: what the scans make of a key that holds every row."""
    one = signal(spark, sf_dir).select(F.lit(0).alias("video_id"), "frame_idx", "t", "raw_diff", "raw_bg")
    s = scans.latched(sig.by_time(one), F.col("raw_diff"), 90.0, 20.0)
    s = scans.scanned(s, row=scans.number(), least=scans.least(F.col("raw_diff")), largest=scans.largest(F.col("raw_diff"), before=True), ago=scans.ago(F.col("raw_bg"), 2), span=scans.largest(F.col("raw_bg"), rows=10), next_t=scans.following(F.col("t")))
    return rounded(s.frame(), "least", "largest", "next_t").select("frame_idx", "row", "on", "least", "largest", "ago", "span", "next_t")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_SCORED = ctes("signal", "quality") + """,
    b as (select video_id, count(*) as n, quantile_cont(raw_diff, [0.05, 0.95]) as d, quantile_cont(raw_bg, [0.05, 0.95]) as g, quantile_cont(raw_flow, [0.05, 0.95]) as f from signal group by 1),
    normed as (select s.*, case when n < 4 or d[2] - d[1] < 1e-6 then 0 else greatest(0, least(1, (raw_diff - d[1]) / (d[2] - d[1]))) end as norm_diff,
        case when n < 4 or g[2] - g[1] < 1e-6 then 0 else greatest(0, least(1, (raw_bg - g[1]) / (g[2] - g[1]))) end as norm_bg,
        case when n < 4 or f[2] - f[1] < 1e-6 then 0 else greatest(0, least(1, (raw_flow - f[1]) / (f[2] - f[1]))) end as norm_flow from signal s join b using (video_id)),
    scored as (select *, round(norm_diff * 0.35::double + norm_bg * 0.35::double + norm_flow * 0.30::double, 6) as score from normed)"""
_FINAL = _SCORED + """,
    jumped as (select q.*, case when count(*) over w < 2 then 0 else max(brightness) over w - min(brightness) over w end as jump from quality q join signal using (video_id, frame_idx)
        window w as (partition by video_id order by t, frame_idx rows between 9 preceding and current row)),
    joined as (select s.*, j.frame_idx is not null as matched, case when j.frame_idx is null then 1 else 1 - (least(1, shake / 20) + greatest(0, least(1, (50 - blur) / 50)) + least(1, jump / 40)) / 3 end as q, coalesce(flag, 0) as flag
        from scored s left join jumped j using (video_id, frame_idx)),
    final as (select *, greatest(0, least(1, score * q)) as s_final from joined)"""
_EVENTS = _FINAL + """,
    st as (select *, coalesce(last_value(case when s_final >= 0.30 then 1 when s_final < 0.15 then 0 end ignore nulls) over (partition by video_id order by t, frame_idx rows between unbounded preceding and current row), 0) as on_event from final),
    st2 as (select *, lag(on_event, 1, 0) over w as was, lead(t) over w as next_t, max(t) over (partition by video_id) as video_end from st window w as (partition by video_id order by t, frame_idx)),
    st3 as (select *, sum(case when on_event = 1 and was = 0 then 1 else 0 end) over (partition by video_id order by t, frame_idx rows unbounded preceding) as run from st2),
    raw as (select video_id, run, min(t) as s, max(coalesce(next_t, video_end)) as e, any_value(video_end) as video_end from st3 where on_event = 1 group by 1, 2),
    g1 as (select *, sum(case when p is null or s - p > 3600 then 1 else 0 end) over (partition by video_id order by s rows unbounded preceding) as g from (select *, lag(e) over (partition by video_id order by s) as p from raw)),
    m as (select video_id, g, min(s) as s, max(e) as e, any_value(video_end) as video_end from g1 group by 1, 2),
    pad as (select video_id, greatest(0, s - 10800) as s, least(video_end, e + 10800) as e, s as us, e as ue from m where e - s >= 5400),
    g2 as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by video_id order by s rows unbounded preceding) as g from (select *, max(e) over (partition by video_id order by s rows between unbounded preceding and 1 preceding) as p from pad)),
    evs as (select video_id, 'full_event' as kind, min(s) as s, max(e) as e, min(us) as us, max(ue) as ue, count(*) - 1 as merges from g2 group by video_id, g union all select video_id, 'short_motion', s, e, s, e, 0 from m where e - s < 5400),
    found as (select *, row_number() over (partition by video_id order by s, us, kind) as event_id from evs)"""
_SCAN = ctes("signal") + """,
    lim as (select video_id, greatest(quantile_cont(raw_bg / 100, 0.75), 0.02) as threshold, max(t) as video_end from signal group by 1),
    act as (select video_id, threshold, greatest(0, t - 10800) as s, least(video_end, t + 10800) as e from signal join lim using (video_id) where raw_bg / 100 >= threshold),
    g as (select *, sum(case when p is null or s - p > 1800 then 1 else 0 end) over (partition by video_id order by s, e rows unbounded preceding) as g from (select *, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) as p from act)),
    win as (select video_id, printf('W%02d', g::int) as window_id, min(s) as s, max(e) as e, count(*) as samples, any_value(threshold) as threshold from g group by video_id, g having max(e) - min(s) >= 25200)"""
_W = "window w as (partition by video_id order by t, frame_idx)"

ORACLE_SQL = {
    "q_percentile_norm": _SCORED + " select video_id, frame_idx, round(norm_diff, 6) as norm_diff, round(norm_bg, 6) as norm_bg, round(norm_flow, 6) as norm_flow, score from scored",
    "q_running_minmax": ctes("signal") + " select video_id, frame_idx, round(case when hi - lo < 1e-6 then 0 else greatest(0, least(1, (raw_diff - lo) / (hi - lo))) end, 6) as running from (select *, min(raw_diff) over w as lo, max(raw_diff) over w as hi from signal window w as (partition by video_id order by t, frame_idx rows unbounded preceding))",
    "q_warmup_gate": ctes("signal") + f' select video_id, frame_idx, row_number() over w as "row", case when row_number() over w <= 10 then 0 else raw_bg end as raw_bg from signal {_W}',
    "q_brightness_jump": ctes("signal") + " select video_id, frame_idx, round(case when count(*) over w < 2 then 0 else max(raw_diff) over w - min(raw_diff) over w end, 6) as jump from signal window w as (partition by video_id order by t, frame_idx rows between 9 preceding and current row)",
    "q_lag_diff": ctes("signal") + f" select video_id, frame_idx, round(coalesce(abs(raw_diff - lag(raw_diff, 2) over w), 0), 6) as difference from signal {_W}",
    "q_shake_hold": ctes("signal") + " select video_id, frame_idx, last_value(case when (n - 1) % 3 = 0 then raw_bg end ignore nulls) over (partition by video_id order by t, frame_idx rows between unbounded preceding and current row) as raw_bg from (select *, row_number() over (partition by video_id order by t, frame_idx) as n from signal)",
    "q_s_final": _FINAL + " select video_id, frame_idx, round(q, 10) as q, flag, matched, round(s_final, 10) as s_final from final",
    "q_q_observability": _FINAL + " select video_id, count(*) filter (matched) as with_quality, count(*) filter (not matched) as without, sum(flag)::bigint as flagged, round(avg(q), 5) as mean_q, round(min(q), 5) as least_q from final group by 1",
    "q_hysteresis": _SCORED + " select video_id, frame_idx, coalesce(last_value(case when score >= 0.30 then 1 when score < 0.15 then 0 end ignore nulls) over (partition by video_id order by t, frame_idx rows between unbounded preceding and current row), 0) as on_event from scored",
    "q_segment_events": _EVENTS + ' select video_id, kind, round(s, 3) as start, round(e, 3) as "end", round(us, 3) as unpadded_start, round(ue, 3) as unpadded_end, merges, event_id from found',
    "q_event_stats": _EVENTS + """ select *, case when camera_share >= 0.5 then 'camera_motion' when camera_share < 0.1 then 'real_motion' else 'mixed' end as label from
        (select *, round(camera_frames / frames, 10) as camera_share from (select f.video_id, event_id, kind, count(*) as frames, round(max(s_final), 10) as peak, round(avg(s_final), 10) as mean, round(min(s_final), 10) as least, round(max(score), 10) as peak_evidence, round(avg(q), 10) as mean_q,
        sum(flag)::bigint as camera_frames, min(frame_idx) as first_frame, max(frame_idx) as last_frame from found e join final f on f.video_id = e.video_id and t between us and ue group by 1, 2, 3))""",
    "q_scan_windows": _SCAN + ' select video_id, window_id, round(s, 4) as start, round(e, 4) as "end", samples, round(threshold, 4) as threshold from win',
    "q_scan_coverage": _SCAN + " select v.video_id, coalesce(windows, 0) as windows, round(coalesce(covered, 0), 4) as covered, round(case when length = 0 then 0 else coalesce(covered, 0) / length end, 4) as coverage from (select video_id, max(t) - min(t) as length from signal group by 1) v left join (select video_id, count(*) as windows, sum(e - s) as covered from win group by 1) c using (video_id)",
    "q_activity_buckets": _EVENTS + """, v as (select video_id, min(t) as origin, max(t) - min(t) as length from signal group by 1)
        select video_id, bucket, count(*) as events from (select f.video_id, unnest(list_filter(range(48), lambda b: s < origin + (b + 1) * (length / 48) and e > origin + b * (length / 48)))::int as bucket from found f join v using (video_id) where e > s) group by 1, 2""",
    "q_hold_duration": ctes("signal") + f" select video_id, frame_idx, round(greatest(0.04, coalesce(lead(t) over w, t) - t), 5) as hold from signal {_W}",
    "q_one_series": ctes("signal") + """ select frame_idx, row_number() over w as "row", coalesce(last_value(case when raw_diff >= 90 then 1 when raw_diff < 20 then 0 end ignore nulls) over (w rows unbounded preceding), 0) as "on",
        round(min(raw_diff) over (w rows unbounded preceding), 6) as least, round(max(raw_diff) over (w rows between unbounded preceding and 1 preceding), 6) as largest, lag(raw_bg, 2) over w as ago,
        max(raw_bg) over (w rows between 9 preceding and current row) as span, round(lead(t) over w, 6) as next_t from signal window w as (order by t, frame_idx)""",
}
