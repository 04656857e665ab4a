"""Queries over verdicts, calibration, fleet drift, ledgers, ranking and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

from ..operators import drift, graph, ledger, ranking, regions, review
from ..sources import adapters
from ..sources.adapters import ctes
from ..sources.storage import stored


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_set(spark, sf_dir)


def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.separability(adapters.review(spark, sf_dir))


def q_best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.best_cuts(adapters.review(spark, sf_dir))


def q_threshold_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.proposals(adapters.review(spark, sf_dir), current=0.005, least_auc=0.5)


def q_verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = adapters.table(spark, sf_dir, "documents"), adapters.table(spark, sf_dir, "labels")
    moved = labels.select((F.col("doc_id") + F.col("toxic") * 1_000_000_000).alias("doc_id"))
    return review.verdict_match(docs, moved, ["doc_id"])


def q_verdict_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = adapters.table(spark, sf_dir, "documents"), adapters.table(spark, sf_dir, "labels")
    moved = labels.select((F.col("doc_id") + F.col("toxic") * 1_000_000_000).alias("doc_id"), "quality")
    return moved.join(docs, "doc_id", "left_anti")


def q_latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    v = e.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("entry"), F.when(F.col("value") > 20, "confirmed").when(F.col("value") > 5, "dismissed").alias("verdict"))
    return review.latest_verdicts(v).select("key", "entry", "verdict")


def q_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"), (F.col("n_chars") < 50).alias("suppressed"))
    v = adapters.review(spark, sf_dir).select("doc_id", "verdict")
    return review.report_summary(d.join(v, "doc_id", "left"))


def q_eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    t = adapters.seconds(F.col("ts"))
    clip = (F.col("user_id") % 20).alias("clip")
    det = e.where("event_type <> 'error'").select(clip, F.col("event_id").alias("det_id"), F.col("event_type").alias("type"), t.alias("start"), (t + F.col("value")).alias("end"))
    verdict = F.when(F.col("value") > 10, "true positive").when(F.col("value") > 4, "false positive").otherwise("ambiguous").alias("verdict")
    adj = e.select(clip, F.col("event_id").alias("adj_id"), F.col("event_type").alias("type"), (t + (F.col("event_id") % 5) * 0.2).alias("at_sec"), verdict)
    ann = e.where("event_type = 'error'").select(clip, F.col("event_id").alias("ann_id"), t.alias("from_sec"), (t + F.col("value") * 60).alias("to_sec"), (F.col("value") > 3).alias("genuine"))
    clips = e.groupBy(clip).agg((F.count(F.lit(1)) * 10).alias("person_seconds"))
    return review.detector_scores(det, adj, ann, clips)


def baselines(spark: SparkSession, sf_dir: str, session: int) -> DataFrame:
    return regions.baselines(adapters.activity(spark, sf_dir).where(F.col("session") == session), ["camera"])


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = adapters.activity(spark, sf_dir).groupBy("camera").agg((F.max("camera") % 17 != 3).alias("comparable"))
    return drift.drift(cameras, baselines(spark, sf_dir, 1), baselines(spark, sf_dir, 2), tolerance=0.6)


def q_fold_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.fold_guarded(baselines(spark, sf_dir, 1), baselines(spark, sf_dir, 2), reports(spark, sf_dir))


def q_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir)


def q_fleet_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.fleet_order(reports(spark, sf_dir)).select("camera", "verdict", "place")


def q_centre_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.rollup(reports(spark, sf_dir).withColumn("site", F.col("camera") % 9), "site")


def q_top_k_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.worst_regions(baselines(spark, sf_dir, 1), baselines(spark, sf_dir, 2))


def q_chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.chained(adapters.ledger_turns(spark, sf_dir)).select("job_id", "seq", "prev_hash", "entry_hash")


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which statements, links and numbers were changed, and some entries are gone."""
    log = ledger.chained(adapters.ledger_turns(spark, sf_dir))
    at = lambda k: (F.col("job_id") % 10 == k) & (F.col("seq") == 2)
    log = log.where(~at(0)).withColumn("statement_hash", F.when(at(1), F.sha2(F.lit("x"), 256)).otherwise(F.col("statement_hash")))
    return log.withColumn("prev_hash", F.when(at(2), F.lit("f" * 64)).otherwise(F.col("prev_hash"))).withColumn("entry_hash", F.when(at(3), F.lit("e" * 64)).otherwise(F.col("entry_hash")))


def q_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ledger.chained(adapters.ledger_turns(spark, sf_dir))
    bad = ledger.problems(log, adapters.ledger_turns(spark, sf_dir)).groupBy("job_id").agg(F.count(F.lit(1)).alias("problems"))
    return log.groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "seq").alias("head")).join(bad, "job_id", "left").fillna({"problems": 0})


def q_tamper_localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.problems(tampered(spark, sf_dir), adapters.ledger_turns(spark, sf_dir))


def q_merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merkle_roots(adapters.ledger_turns(spark, sf_dir), data="statement_hash")


def q_merkle_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merkle_proofs(adapters.ledger_turns(spark, sf_dir), data="statement_hash").select("job_id", "i", "level", "side", "sibling")


def q_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents whose numbers, keys and nesting are written in other ways than the canonical one."""
    e = adapters.table(spark, sf_dir, "events")
    n = (F.col("event_id") % 900 + 1).cast("string")
    parts = ['{"value": ', n, '.0, "props": ', F.col("props"), ', "kind": "', F.col("event_type"), '", "z": [-0.0, ', n, 'e-9, {"b": ', n, '.50, "a": ', n, 'E2}], "\\ud83d\\ude00": 1, "\uff5e": "a\\u0041\\/\\u0007"}']
    return e.select("event_id", F.sha2(ledger.canonical_json(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])), 256).alias("digest"))


def q_canonical_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts have no canonical form: unsafe integers, non-finite numbers, no JSON."""
    e = adapters.table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"n": '), F.element_at(F.array(*map(F.lit, ("9007199254740991", "9007199254740992", "1e20", "1e400", "NaN", "1.5e300", "[", "-9007199254740993"))), (F.col("event_id") % 8 + 1).cast("int")), F.lit("}"))
    return e.select("event_id", ledger.canonical_json(text).alias("form"))


def q_priority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    phone, paper = F.col("phones") > 0, F.col("papers") > 0
    return e.select("event_id", scalars.priority(phone, F.col("motion"), F.col("persons")).alias("priority"), scalars.event_kind(phone & (F.col("phones") > 1), paper & (F.col("papers") > 1), F.col("persons"), F.col("camera_share")).alias("kind"))


def q_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bands = {"camera_shake": scalars.uncertainty_band(F.col("camera_share")), "lighting_change": scalars.uncertainty_band(F.col("motion")), "blur": F.lit("unavailable"), "occlusion": F.lit("unavailable")}
    return e.select("event_id", bands["camera_shake"].alias("camera_shake"), bands["lighting_change"].alias("lighting_change"), scalars.dominant(bands).alias("dominant"))


def q_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"claim": F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("seen: "), "status")).otherwise(F.lit("  ")), "uncertainty": F.when(F.col("event_id") % 3 != 0, F.lit("low"))})
    kind = scalars.grounding(F.col("phones") > 0, F.col("persons") > 2, F.col("papers"), F.col("claim"))
    return ranking.explanations(e, kind).select("event_id", "claim", "uncertainty", "grounding")


def q_profile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    named = ranking.signals(F.col("motion"), F.col("object_score"), F.col("persons") / 7.0, 1 - F.col("camera_share"))
    return ranking.ranked(ranking.profile_scores(e, named), ["video_id", "profile"], "event_id").select("video_id", "profile", "event_id", "place")


def q_evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("video_id"), adapters.seconds(F.col("o_orderdate")).alias("start"))
    b = adapters.boxes(spark, sf_dir).groupBy(F.col("frame_idx").alias("event_id")).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    seen = adapters.boxes(spark, sf_dir).select(F.col("frame_idx").alias("event_id"), "track_id").join(o, "event_id").select("video_id", "event_id", "track_id").distinct()
    # both are read for the links, for the groups and for what their events share
    ev, seen = stored(o.join(b, "event_id"), "evidence-events"), stored(seen, "evidence-seen")
    return graph.evidence_groups(graph.evidence_edges(ev, seen, seconds=30 * 86400.0), ev, seen)


def q_owner_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), "c_nationkey")
    return ranking.visible_to(events(spark, sf_dir), c, F.col("c_nationkey") == 7, ["video_id"]).select("event_id", "video_id", "motion")


def q_findings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    return ranking.found(d, ["source", "text"], "idiot", lang="en").select("doc_id", "source")


def q_findings_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("findings"), F.sum("n_chars").alias("chars"))


def q_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "embeddings")
    images = e.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("vector"))
    mean = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.round(F.avg(F.col("col").cast("double")), 6).alias("x"))
    captions = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    out = ranking.zero_shot(images, captions, innocent=["0", "1"])
    return out.withColumns({c: F.round(c, 5) for c in ("top_score", "margin")})


def q_text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "pages")
    c = adapters.seconds(F.to_timestamp(F.lit("2024-01-01"))) * 0 + F.col("page_id") * 7.3
    return p.select("page_id", scalars.slug(F.col("url")).alias("slug"), scalars.clock(c).alias("clock"), F.sha2(scalars.html_escaped(F.col("html")), 256).alias("escaped"), scalars.fraction(F.concat(F.col("page_id").cast("string"), F.lit("/"), (F.col("page_id") % 4).cast("string"))).alias("fraction"), scalars.finding_key(F.lit("job"), F.when(F.col("page_id") % 2 == 0, F.col("page_id")), F.lit("phone"), F.col("page_id")).alias("key"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_REV = ctes("review")
_CUT = _REV + """, c as (select type, confidence, count(*) filter (verdict = 'confirmed') as c, count(*) filter (verdict = 'dismissed') as d from review group by 1, 2),
    mid as (select type, (confidence + lead(confidence) over (partition by type order by confidence)) / 2 as cut from c), cand as (select type, cut from mid where cut is not null union all select distinct type, 0.0::double from c),
    s as (select cand.type, cut, sum(case when confidence >= cut then c else 0 end) as tp, sum(case when confidence >= cut then d else 0 end) as fp, sum(c) as p, sum(d) as n from cand join c on c.type = cand.type group by 1, 2),
    best as (select type, cut, j from (select *, row_number() over (partition by type order by j desc, cut) as rn from (select type, cut, round(tp / p::double - fp / n::double, 9) as j from s where p > 0 and n > 0)) where rn = 1),
    auc as (select a.type, a.n, a.confirmed, a.dismissed, round(coalesce(wins / nullif(a.confirmed * a.dismissed, 0), 0.5), 3) as auc from (select type, count(*) as n, count(*) filter (verdict = 'confirmed') as confirmed, count(*) filter (verdict = 'dismissed') as dismissed from review group by 1) a
        left join (select x.type, sum(x.c * y.d * case when x.confidence > y.confidence then 1.0::double when x.confidence = y.confidence then 0.5::double else 0 end) as wins from c x join c y on x.type = y.type group by 1) w using (type))"""
_BASE = ctes("activity") + """, n as (select *, row_number() over (partition by camera, session, region order by frame_idx) as rn from activity),
    base as (select camera, session, region, round(avg(activity), 6) as mu, round(greatest(0.001, stddev_pop(activity)), 6) as sigma, count(*) as samples from n where rn <= 150 group by 1, 2, 3),
    p as (select * from base where session = 1), s as (select * from base where session = 2),
    sh as (select camera, region, round(abs(s.mu - p.mu) / greatest(p.sigma, 0.001), 2) as shift from p join s using (camera, region)),
    rep as (select c.camera, case when k.camera is null then 'no_baseline' when c.camera % 17 = 3 or n is null then 'unusable' when m = 0 then 'stable' when m / n::double >= 0.5 and m >= 3 then 'camera_moved' else 'scene_changed' end as verdict, n, m, peak
        from (select distinct camera from activity) c left join (select distinct camera from p) k using (camera) left join (select camera, count(*) as n, count(*) filter (shift > 0.6) as m, max(shift) as peak from sh group by 1) a using (camera)),
    report as (select camera, verdict, case when verdict in ('stable', 'camera_moved', 'scene_changed') then m else 0 end as regions_shifted, case when verdict in ('stable', 'camera_moved', 'scene_changed') then n else 0 end as regions_compared, case when verdict in ('stable', 'camera_moved', 'scene_changed') then peak else 0 end as peak_shift,
        case verdict when 'unusable' then 0 when 'camera_moved' then 1 when 'scene_changed' then 2 when 'no_baseline' then 3 else 4 end as severity from rep)"""
_CHAIN = ctes("ledger") + """, links as (select job_id, seq, statement_hash, repeat('0', 64) as prev_hash, sha256(length(seq::varchar) || ':' || seq || '|64:' || repeat('0', 64) || '|64:' || statement_hash) as entry_hash from ledger where seq = 1
    union all select l.job_id, l.seq, l.statement_hash, k.entry_hash, sha256(length(l.seq::varchar) || ':' || l.seq || '|64:' || k.entry_hash || '|64:' || l.statement_hash) from links k join ledger l on l.job_id = k.job_id and l.seq = k.seq + 1)"""
_MERKLE = ctes("ledger") + """, lv as (select job_id, 0 as level, row_number() over (partition by job_id order by seq) - 1 as i, sha256('00' || statement_hash) as h, count(*) over (partition by job_id) as n from ledger
    union all select job_id, level + 1, i // 2, case when r is null then h else sha256('01' || h || r) end, (n + 1) // 2 from (select *, lead(h) over (partition by job_id order by i) as r from lv where n > 1) where i % 2 = 0)"""
_EV = ctes("boxes", "event_set")

ORACLE_SQL = {
    "q_auc": _CUT + " select * from auc",
    "q_best_cut": _CUT + " select type, round(cut, 6) as cut, j from best",
    "q_threshold_proposal": _CUT + """, st as (select auc.*, round(cut, 6) as cut0, case when n < 10 then 'insufficient_data' when dismissed = 0 then 'already_clean' when confirmed = 0 then 'not_separable' when auc < 0.5 then 'not_separable' when round(cut, 6) <= 0.005 then 'already_clean' else 'proposed' end as status from auc left join best using (type))
        select type, n, confirmed, dismissed, auc, status, case when status = 'proposed' then cut0 end as cut, case when status = 'proposed' then (select count(*) from review r where r.type = st.type and verdict = 'dismissed' and confidence < cut0) end as suppressed, case when status = 'proposed' then (select count(*) from review r where r.type = st.type and verdict = 'confirmed' and confidence < cut0) end as lost from st""",
    "q_verdict_join": "with v as (select doc_id + toxic * 1000000000 as doc_id from labels) select count(*) filter (d.doc_id is not null and v.doc_id is not null) as matched, count(*) filter (v.doc_id is null) as unmatched, count(*) filter (d.doc_id is null) as orphaned from documents d full join v on d.doc_id = v.doc_id",
    "q_verdict_orphans": "select doc_id, quality from (select doc_id + toxic * 1000000000 as doc_id, quality from labels) v where not exists (select 1 from documents d where d.doc_id = v.doc_id)",
    "q_latest_verdict": "select key, entry, verdict from (select *, row_number() over (partition by key order by ts desc, entry desc) as rn from (select user_id || '|' || event_type as key, ts, event_id as entry, case when value > 20 then 'confirmed' when value > 5 then 'dismissed' end as verdict from events)) where rn = 1 and verdict is not null",
    "q_report_summary": _REV + """ select *, round(confirmed / nullif(confirmed + dismissed, 0)::double, 3) as precision from (select lang as type, count(*) as findings, count(*) filter (verdict = 'confirmed') as confirmed, count(*) filter (verdict = 'dismissed') as dismissed, count(*) filter (n_chars < 50) as auto_filtered, count(*) filter (verdict is null and n_chars >= 50) as awaiting
        from documents d left join review r using (doc_id) group by 1)""",
    "q_eval_scores": """with e as (select *, epoch_us(ts) / 1000000.0::double as t, user_id % 20 as clip from events), det as (select clip, event_id as det_id, event_type as type, t as s, t + value as e from e where event_type <> 'error'),
        adj as (select clip, event_id as adj_id, event_type as type, t + (event_id % 5) * 0.2::double as at_sec, case when value > 10 then 'true positive' when value > 4 then 'false positive' else 'ambiguous' end as verdict from e), ann as (select clip, event_id as ann_id, t as a, t + value * 60 as b from e where event_type = 'error' and value > 3),
        j as (select det.clip, det_id, arg_min(verdict, adj_id) as verdict from det left join adj on adj.clip = det.clip and adj.type = det.type and abs(at_sec - s) < 0.5 group by 1, 2),
        c as (select clip, count(*) filter (verdict = 'true positive') as tp, count(*) filter (verdict = 'false positive') as fp, count(*) filter (verdict = 'ambiguous') as ambiguous, count(*) filter (verdict is null) as unadjudicated from j group by 1),
        f as (select clip, count(*) as fn from ann where not exists (select 1 from det where det.clip = ann.clip and a <= e and s <= b) group by 1),
        r as (select k.clip, person_seconds, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(ambiguous, 0) as ambiguous, coalesce(unadjudicated, 0) as unadjudicated, coalesce(fn, 0) as fn from (select clip, count(*) * 10 as person_seconds from e group by 1) k left join c using (clip) left join f using (clip)),
        pr as (select *, person_seconds - tp - fn - fp as tn, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as r from r)
        select clip, person_seconds, tp, fp, ambiguous, unadjudicated, fn, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, round((tp + tn) / person_seconds::double, 6) as accuracy, round((person_seconds - tp - fn) / person_seconds::double, 6) as do_nothing,
            round((r + coalesce(tn / nullif(tn + fp, 0)::double, 0)) / 2, 6) as balanced_accuracy from pr""",
    "q_fold_session": _BASE + """, j as (select coalesce(p.camera, s.camera) as camera, coalesce(p.region, s.region) as region, p.mu as m0, p.sigma as s0, p.samples as n0, s.mu as m1, s.sigma as s1, s.samples as n1 from p full join (select * from s where camera in (select camera from rep where verdict not in ('camera_moved', 'unusable'))) s on p.camera = s.camera and p.region = s.region),
        m as (select *, (m0 * n0 + m1 * n1) / (n0 + n1) as mm from j)
        select camera, region, floor((case when n0 is null then m1 when n1 is null then m0 else mm end) * 1e6 + 0.5) / 1e6 as mu, floor((case when n0 is null then s1 when n1 is null then s0 else sqrt(greatest(1e-6, (n0 * (s0 * s0 + (m0 - mm) * (m0 - mm)) + n1 * (s1 * s1 + (m1 - mm) * (m1 - mm))) / (n0 + n1))) end) * 1e6 + 0.5) / 1e6 as sigma, (coalesce(n0, 0) + coalesce(n1, 0))::bigint as samples from m""",
    "q_drift": _BASE + " select camera, verdict, regions_shifted, regions_compared, peak_shift from report",
    "q_fleet_rank": _BASE + " select camera, verdict, row_number() over (order by severity, peak_shift desc, camera) as place from report",
    "q_centre_rollup": _BASE + " select camera % 9 as site, count(*) as cameras, arg_min(verdict, severity) as worst, count(*) filter (verdict not in ('stable', 'no_baseline')) as problems, max(peak_shift) as peak_shift from report group by 1",
    "q_top_k_regions": _BASE + " select camera, rank, region, shift from (select *, row_number() over (partition by camera order by shift desc, region) as rank from sh) where rank <= 3",
    "q_chain_build": _CHAIN + " select job_id, seq, prev_hash, entry_hash from links",
    "q_chain_verify": _CHAIN + " select job_id, count(*) as entries, arg_max(entry_hash, seq) as head, 0 as problems from links group by 1",
    "q_tamper_localise": _CHAIN + """, t as (select job_id, seq, case when job_id % 10 = 1 and seq = 2 then sha256('x') else statement_hash end as statement_hash, case when job_id % 10 = 2 and seq = 2 then repeat('f', 64) else prev_hash end as prev_hash, case when job_id % 10 = 3 and seq = 2 then repeat('e', 64) else entry_hash end as entry_hash, statement_hash as true_hash from links where not (job_id % 10 = 0 and seq = 2)),
        w as (select *, row_number() over (partition by job_id order by seq) as want_seq, lag(entry_hash, 1, repeat('0', 64)) over (partition by job_id order by seq) as want_prev from t)
        select job_id, seq, 'sequence_gap' as problem from w where seq <> want_seq union all select job_id, seq, 'broken_link' from w where prev_hash <> want_prev union all select job_id, seq, 'statement_altered' from w where true_hash <> statement_hash
        union all select job_id, seq, 'entry_hash_mismatch' from w where entry_hash <> sha256(length(seq::varchar) || ':' || seq || '|64:' || prev_hash || '|64:' || statement_hash)""",
    "q_merkle_root": _MERKLE + " select job_id, h as root from lv where n = 1",
    "q_merkle_proof": _MERKLE + " select a.job_id, a.i, b.level, case when (a.i >> b.level) % 2 = 0 then 'right' else 'left' end as side, b.h as sibling from lv a join lv b on a.job_id = b.job_id and a.level = 0 and b.i = xor(a.i >> b.level, 1)",
    # the same documents, written canonically
    "q_canonical_json": """with e as (select *, event_id % 900 + 1 as n, json_extract_string(props, '$.k') as k from events),
        x as (select *, length(rtrim(n::varchar, '0')) as sig, rtrim(n::varchar, '0') as fig, length(n::varchar) as len from e)
        select event_id, sha256('{"kind":"' || event_type || '","props":{"k":' || k || '},"value":' || n || ',"z":[0,' ||
            fig[1] || case when sig > 1 then '.' || fig[2:] else '' end || 'e-' || (10 - len) ||
            ',{"a":' || (n * 100) || ',"b":' || n || '.5}],"' || chr(128512) || '":1,"' || chr(65374) || '":"aA/\\u0007"}') as digest from x""",
    "q_canonical_refused": "select event_id, case event_id % 8 when 0 then '{\"n\":9007199254740991}' end as form from events",
    "q_priority_type": _EV + " select event_id, case when phones > 0 or motion > 0.7 then 'high' when persons > 0 or motion > 0.4 then 'medium' else 'low' end as priority, case when phones > 1 then 'phone_activity' when papers > 1 then 'paper_activity' when persons > 1 then 'proximity' when camera_share > 0.5 then 'camera_motion' else 'unusual_motion' end as kind from event_set",
    "q_uncertainty": _EV + """, b as (select event_id, case when camera_share > 0.6 then 'high' when camera_share >= 0.3 then 'medium' else 'low' end as camera_shake, case when motion > 0.6 then 'high' when motion >= 0.3 then 'medium' else 'low' end as lighting_change from event_set)
        select *, case when lighting_change = 'high' and camera_shake <> 'high' or lighting_change = 'medium' and camera_shake = 'low' then 'lighting_change: ' || lighting_change else 'camera_shake: ' || camera_shake end as dominant from b""",
    "q_grounding": _EV + " select event_id, 'seen: ' || status as claim, case when event_id % 3 <> 0 then 'low' else 'unavailable' end as uncertainty, case when (phones > 0 or persons > 2) and papers >= 1 then 'full' when phones > 0 or persons > 2 then 'spatial' else 'temporal' end as grounding from event_set where event_id % 13 <> 0 and (phones > 0 or persons > 2 or papers >= 1)",
    "q_profile_rank": _EV + """, s as (select *, greatest(0, least(1, motion)) as m, greatest(0, least(1, object_score)) as o, greatest(0, least(1, persons / 7.0::double)) as p, greatest(0, least(1, 1 - camera_share)) as q from event_set),
        u as (select video_id, event_id, 'phone_activity' as profile, round(o * 0.6::double + m * 0.2::double + q * 0.2::double, 4) as score from s union all select video_id, event_id, 'seat_exchange', round(m * 0.5::double + p * 0.3::double + q * 0.2::double, 4) from s
        union all select video_id, event_id, 'neighbor_interaction', round(p * 0.6::double + m * 0.3::double + q * 0.1::double, 4) from s union all select video_id, event_id, 'camera_disturbance', round((1 - q) * 0.8::double + m * 0.2::double, 4) from s union all select video_id, event_id, 'all_unusual', round(m * 0.4::double + o * 0.3::double + q * 0.3::double, 4) from s)
        select video_id, profile, event_id, row_number() over (partition by video_id, profile order by score desc, event_id) as place from u""",
    "q_evidence_graph": ctes("boxes") + """, o as (select o_orderkey as event_id, o_custkey as video_id, epoch_us(o_orderdate) / 1000000.0::double as start from orders), b as (select frame_idx as event_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from boxes group by 1),
        ev as (select * from o join b using (event_id)), seen as (select distinct video_id, event_id, track_id from boxes join o on event_id = frame_idx),
        e as (select distinct a.event_id as a, b.event_id as b, 'same_subject' as reason from seen a join seen b on a.video_id = b.video_id and a.track_id = b.track_id and a.event_id < b.event_id
          union select a.event_id, b.event_id, 'same_place' from ev a join ev b on a.video_id = b.video_id and a.event_id < b.event_id and abs(a.start - b.start) < 2592000 and (greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)))::double / ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-(greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)))) > 0.3 and not exists (select 1 from seen x join seen y on x.track_id = y.track_id where x.event_id = a.event_id and y.event_id = b.event_id)),
        l as (select a as u, b as v from e union select b, a from e), r as (select u as node, u as root from l union select l.v, r.root from r join l on l.u = r.node), m as (select node, min(root) as root from r group by 1),
        why as (select root, string_agg(distinct reason, ',' order by reason) as reasons from e join m on node = a group by 1),
        sh as (select root, count(*) as shared from (select root, track_id from (select distinct event_id, track_id from seen) join m on node = event_id group by 1, 2 having count(*) > 1) group by 1),
        g as (select video_id, root, count(*) as events, round(max(start) - min(start), 2) as span, any_value(reasons) as reasons, coalesce(any_value(shared), 0) as shared from ev join m on node = event_id join why using (root) left join sh using (root) group by 1, 2)
        select *, row_number() over (partition by video_id order by events desc, root) as place from g""",
    "q_owner_visible": _EV + " select event_id, video_id, motion from event_set e where exists (select 1 from customer where c_custkey = video_id and c_nationkey = 7)",
    "q_findings_search": "select doc_id, source from documents where lang = 'en' and (contains(lower(coalesce(source, '')), 'idiot') or contains(lower(coalesce(text, '')), 'idiot'))",
    "q_findings_facets": "select lang, source, count(*) as findings, sum(n_chars)::bigint as chars from documents group by 1, 2",
    "q_zero_shot": """with x as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings), mean as (select label, pos, round(avg(v), 6) as m from x group by 1, 2),
        nm as (select label, sqrt(sum(m * m)) as n from mean group by 1), nv as (select vec_id, sqrt(sum(v * v)) as n from x group by 1),
        c as (select x.vec_id, mean.label, sum(v * m) as dot from x join mean using (pos) group by 1, 2), s as (select c.vec_id, c.label, coalesce(dot / nullif(nv.n * nm.n, 0), 0) * 10 as score from c join nv using (vec_id) join nm using (label)),
        p as (select *, exp(score) / sum(exp(score)) over (partition by vec_id) as p from s), r as (select *, row_number() over (partition by vec_id order by p desc, label desc) as rn, lead(p, 1, 0) over (partition by vec_id order by p desc, label desc) as nxt from p)
        select vec_id as image_id, label as top_label, round(p, 5) as top_score, round(p - nxt, 5) as margin, case when p < 0.45 or p - nxt < 0.15 then 'unjudgeable' when label::varchar like '0%' or label::varchar like '1%' then 'contradicted' else 'supported' end as verdict from r where rn = 1""",
    "q_text_helpers": r"""select page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) as slug, printf('%d:%04.1f', floor(page_id * 7.3::double / 60)::int, page_id * 7.3::double - floor(page_id * 7.3::double / 60) * 60) as clock,
        sha256(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped, case when page_id % 4 = 0 then 0 else page_id / (page_id % 4)::double end as fraction, 'job::' || case when page_id % 2 = 0 then page_id::varchar else 'none' end || '|phone|' || page_id as key from pages""",
}
