"""Queries over reports, summaries, lists and the remaining ledger and scan operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, rounding, scalars
from ..functions.geometry import box
from ..operators import drift, findings, ledger, reporting, review, rois, signal, spatial
from ..operators.windows import numbered_globally, ordered
from ..sources import adapters, readers
from ..sources.adapters import ctes
from . import object_queries, review_queries


def rich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with all that the interface's contract needs."""
    k = F.col("event_id")
    e = adapters.event_set(spark, sf_dir)
    jerk = (k * 31 % 1000) / 1000.0
    return e.select(
        "event_id", "video_id", "start", (F.col("start") + k % 600).alias("end"), F.col("motion").alias("peak"), (F.col("motion") / 2).alias("mean"), (1 - F.col("camera_share")).alias("seen"), "camera_share", (k % 50 + 1).alias("frames"), "persons",
        (F.col("phones") > 1).alias("phone"), (F.col("papers") > 1).alias("paper"), scalars.motion_character(jerk).alias("character"), jerk.alias("jerk"), F.when(F.col("persons") > 0, k % 97).alias("track_id"), F.when(k % 3 == 0, F.concat(F.lit("clips/"), k.cast("string"))).alias("clip"),
    )


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects seen in events as findings with an id, and whether they are suppressed."""
    b = object_queries.grouped(spark, sf_dir).where(rois.prohibited(F.col("cls"), F.col("conf")))
    kind = F.when(F.col("cls") == "book", "object_exchange").otherwise("prohibited_object")
    label = F.concat(scalars.prohibited_label(F.col("cls")), F.lit(" detected"))
    return b.select(F.col("box_id").alias("finding_id"), F.col("frame_idx").alias("event_id"), "video_id", kind.alias("type"), label.alias("label"), "track_id", (F.col("t") + F.col("roi_id") * 3).alias("start_sec"), F.col("conf").alias("confidence"), (F.col("filled") > 0.07).alias("suppressed"))


def q_api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.api_events(rich_events(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", "; "))


def q_video_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.video_quality(rich_events(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("observability", "camera_shake")})


def q_explanation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per finding, with how its region behaved, and one per event."""
    band = scalars.uncertainty_band(F.col("camera_share"))
    e = rich_events(spark, sf_dir).withColumn("caveat", F.concat(F.lit("camera_shake: "), band))
    f = event_findings(spark, sf_dir).join(e.select("event_id", "caveat"), "event_id")
    f = f.withColumns({"region": F.when(F.col("track_id") % 3 > 0, F.concat(F.lit("r0c"), (F.col("track_id") % 4).cast("string"))), "region_z": (F.col("track_id") % 5).cast("double")})
    return findings.explained(f, e)


def stills_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of stills: some orders' frames have a sampled still, some an annotated one, some events a snapshot."""
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    at = F.format_string("%07d", "k")
    named = {
        3: F.concat(F.lit("/job/frames/cam"), F.col("v").cast("string"), F.lit("__f"), at, F.lit("__t1.5.jpg")),
        5: F.concat(F.lit("/job/out/annotated/annotated_frame_"), at, F.lit(".jpg")),
        7: F.concat(F.lit("/job/out/snapshots/event"), F.col("k").cast("string"), F.lit("_f"), at, F.lit(".jpg")),
        11: F.concat(F.lit("/job/frames/notes_"), at, F.lit(".txt")),
    }
    return readers.stills(o.select(F.explode(F.array_compact(F.array(*[F.when(F.col("k") % n == 0, p) for n, p in named.items()]))).alias("path")))


def findings_with_stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_findings(spark, sf_dir)
    frame = F.when(F.col("finding_id") % 4 == 0, F.lit(0)).otherwise(F.col("event_id")).cast("bigint")
    f = f.withColumns({"video": F.concat(F.lit("cam"), F.col("video_id").cast("string")), "frame_idx": frame, "start_frame": F.col("event_id").cast("bigint")})
    return findings.with_stills(f, stills_of_orders(spark, sf_dir))


def q_stills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best still of each finding."""
    return findings_with_stills(spark, sf_dir).select("finding_id", "still")


def q_grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on findings and events with the frames, stills, regions and boxes that bear them out."""
    band = scalars.uncertainty_band(F.col("camera_share"))
    e = rich_events(spark, sf_dir).withColumns({"caveat": F.concat(F.lit("camera_shake: "), band), "start_frame": F.col("event_id").cast("bigint")})
    e = e.withColumns({c: F.when(F.col("event_id") % 2 == 0, F.col("event_id") % n).cast("bigint") for c, n in (("roi_x1", 7), ("roi_y1", 5), ("roi_x2", 97), ("roi_y2", 89))})
    f = findings_with_stills(spark, sf_dir).join(e.select("event_id", "caveat"), "event_id")
    f = f.withColumns({"region": F.lit(None).cast("string"), "region_z": F.lit(0.0), **{c: F.when(F.col("finding_id") % 3 == 0, F.col("finding_id") % n).cast("bigint") for c, n in (("x1", 7), ("y1", 5), ("x2", 97), ("y2", 89))}})
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return findings.grounded(f, e).select("event_id", "claim", "at", "track_id", text("roi"), text("box"), F.array_join("urls", " ").alias("urls"), "caveat")


def q_finding_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims of its event lie near each finding's start."""
    f = event_findings(spark, sf_dir)
    claims = f.select("event_id", F.col("label").alias("claim"), F.col("start_sec").alias("at"))
    near = findings.near_explanations(f.select("finding_id", "event_id", "start_sec"), claims)
    return near.groupBy("finding_id").agg(F.count("claim").alias("claims"), F.min("at").alias("first_at"))


def q_findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's place in its video's list by time, by confidence and by type."""
    f = event_findings(spark, sf_dir)
    out = f.select("finding_id", "video_id")
    for key in ("time", "confidence", "type"):
        out = out.join(findings.sorted_by(f, key, ["video_id"]).select("finding_id", F.col("place").alias(f"by_{key}")), "finding_id")
    return out


def q_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stills are kept for the first four findings of a video; the rest is counted as left out."""
    return findings.capped(event_findings(spark, sf_dir), 4, ["video_id"], ["event_id", "finding_id"]).select("finding_id", "taken", "omitted")


def q_report_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") < 50).alias("suppressed"))
    rows = review.report_sets(d.join(adapters.review(spark, sf_dir).select("doc_id", "verdict"), "doc_id", "left"))
    return rows.groupBy("confirmed", "dismissed", "auto_filtered", "unreviewed").agg(F.count(F.lit(1)).alias("findings"))


def q_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that their caption contradicts are marked, and only the inspected ones are judged."""
    f = event_findings(spark, sf_dir).drop("suppressed")
    inspected = findings.capped(f, 40, ["video_id"], ["event_id", "finding_id"])
    verdict = F.when(~F.col("taken"), "unjudgeable").when(F.col("confidence") < 0.5, "contradicted").otherwise("supported")
    marked = review.suppressed(inspected.withColumn("clip", verdict), F.col("clip"), F.concat(F.lit("caption contradicts "), F.col("type")))
    return marked.groupBy("video_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if("suppressed").alias("suppressed"), F.max("suppressed_reason").alias("reason"), F.count_if(F.col("clip") == "unjudgeable").alias("unjudgeable"))


def shake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.signal(spark, sf_dir)
    k = F.col("raw_bg").cast("int")
    mode = F.when(k % 5 < 3, "masked").when(k % 5 == 3, "unmasked_fallback").otherwise("cold_start")
    return reporting.trusted_shake(s.select("video_id", "frame_idx", (k % 4 == 0).alias("flow_flag"), (k % 6 < 2).alias("shake_flag"), mode.alias("mode"), (k % 25).cast("double").alias("shake"), ((k % 10) / 10.0).alias("inliers"), F.col("raw_diff").alias("blur")))


def q_shake_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shake_rows(spark, sf_dir).select("frame_idx", "trusted", F.round("shake_for_q", 6).alias("shake_for_q"), "camera_motion")


def q_quality_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.quality_summary(shake_rows(spark, sf_dir))


def q_quality_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.spread(shake_rows(spark, sf_dir), "video_id", ["shake_score", "blur"])


def q_mask_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "lineitem")
    return reporting.mask_cleanup(p.select((F.col("l_suppkey") % 10).alias("video_id"), (F.col("l_partkey") % 100 * 50).alias("before_px"), (F.col("l_orderkey") % 97 * 60).alias("after_px")))


def q_dashboard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reporting.api_events(rich_events(spark, sf_dir))
    f = event_findings(spark, sf_dir)
    return reporting.tiles(e, f, f.where("confidence > 0.6").select(F.col("finding_id").alias("key")))


def q_events_with_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.events_with_detections(rich_events(spark, sf_dir).select("event_id", "video_id"), event_findings(spark, sf_dir))


def q_event_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("event_id"), F.col("o_orderkey").alias("frame_idx"))
    return reporting.event_regions(frames, object_queries.numbered(spark, sf_dir))


def q_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of each video in order of their first box."""
    b = object_queries.grouped(spark, sf_dir)
    return reporting.first_seen(b, ["video_id"], "track_id", "t", "box_id").select("video_id", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("tracks"))


def q_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames take the number of the source row at their place."""
    s = adapters.signal(spark, sf_dir)
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("frame_idx"), F.col("o_orderkey").alias("source_idx"))
    return reporting.by_position(s.select("video_id", "frame_idx"), o, ["video_id"], ["frame_idx"], "source_idx")


def q_invalid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.signal(spark, sf_dir)
    k = F.col("raw_bg").cast("int")
    why = reporting.invalid_frame(F.when(k % 11 > 0, F.lit(3)).otherwise(1), F.when(k % 7 > 0, k % 13), F.floor(F.col("raw_diff") / 5))
    return s.withColumn("why", F.coalesce(why, F.lit("valid"))).groupBy("video_id", "why").agg(F.count(F.lit(1)).alias("frames"))


def q_fleet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst thirty sites with problems whose name has a 1."""
    r = review_queries.reports(spark, sf_dir).withColumn("site", F.concat(F.lit("C"), (F.col("camera") % 60).cast("string")))
    sites = drift.rollup(r, "site").withColumn("severity", drift.severity("worst"))
    return reporting.fleet_search(sites, "1", only_problems=True).select("site", "worst", "problems")


def q_sites_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras by site and camera, both in the order of names."""
    c = adapters.activity(spark, sf_dir).select(F.concat(F.lit("C"), (F.col("camera") % 9).cast("string")).alias("site"), F.concat(F.lit("cam"), F.col("camera").cast("string")).alias("camera")).distinct()
    return numbered_globally(c, "place", scalars.collated(F.col("site")), scalars.collated(F.col("camera")))


def q_names_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of all texts in the order of names, and how often each occurs in whatever case."""
    word = F.regexp_extract("text", "(\\p{L}+)", 1)
    words = adapters.table(spark, sf_dir, "documents").select(word.alias("name")).where("name <> ''")
    # equal but for case: one group, whatever it is called
    alike = words.groupBy(scalars.collated(F.col("name"), "UNICODE_CI").alias("any_case")).agg(F.count(F.lit(1)).alias("alike"))
    names = words.distinct()
    counted = names.join(alike, scalars.collated(names["name"], "UNICODE_CI") == alike["any_case"]).select("name", "alike")
    return numbered_globally(counted, "place", scalars.collated(F.col("name")), F.col("name"))


def q_events_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all videos by start."""
    return numbered_globally(rich_events(spark, sf_dir).select("event_id", "start"), "place", F.col("start"), F.col("event_id"))


def q_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.summary(review_queries.baselines(spark, sf_dir, 1), review_queries.baselines(spark, sf_dir, 2), tolerance=0.6).withColumns({"share": F.round("share", 6)})


def q_camera_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with their last drift, and none where none was reported."""
    profiles = review_queries.baselines(spark, sf_dir, 1).groupBy("camera").agg(F.count(F.lit(1)).alias("regions"), F.sum("samples").alias("samples"))
    return profiles.join(review_queries.reports(spark, sf_dir).where("regions_compared > 4"), "camera", "left").select("camera", "regions", "samples", F.coalesce("verdict", F.lit("none")).alias("verdict"))


# --- ledger ------------------------------------------------------------------------------


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs with all fields of a statement."""
    c = adapters.table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return c.select(
        F.col("conv_id").alias("job_id"), (F.col("turn") + 1).cast("int").alias("seq"), F.when(F.col("turn") % 2 == 0, "artifact_derived").otherwise("verdict_recorded").alias("kind"), F.concat(F.lit("file/"), (F.col("turn") % 4).cast("string")).alias("subject"),
        F.when(F.col("turn") % 3 > 0, F.col("role")).alias("actor_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.sha2(text, 256).alias("payload_hash"), F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit('.0, "a": [1.50, null]}')).alias("payload"),
    )


def q_statement_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("job_id", F.concat(F.lit("job"), F.col("job_id").cast("string")))
    return e.select("job_id", "seq", ledger.statement_hash().alias("statement_hash"))


def q_ledger_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.batches(adapters.ledger_turns(spark, sf_dir).withColumnRenamed("statement_hash", "entry_hash"))


def q_split_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose last entries were left in a local file."""
    log = ledger.chained(adapters.ledger_turns(spark, sf_dir))
    local = log.where((F.col("job_id") % 3 == 0) & (F.col("seq") > 2))
    main = log.join(local.select("job_id", "seq"), ["job_id", "seq"], "left_anti")
    return ledger.split_chains(main, ledger.orphaned(main, local), ledger.problems(main))


def q_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was deleted or altered between two states of the logs."""
    before = ledger.chained(adapters.ledger_turns(spark, sf_dir))
    return ledger.violations(before, review_queries.tampered(spark, sf_dir))


def q_artifact_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.artifact_hashes(entries(spark, sf_dir))


def q_unanchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("anchor_root", F.when(F.col("seq") <= 2, F.col("payload_hash")))
    return ledger.unanchored(e).groupBy("job_id").agg(F.count(F.lit(1)).alias("waiting"), F.min("seq").alias("first"))


def q_report_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report's hash over its canonical form without the block that carries it, and the entry that records it."""
    d = review_queries.q_report_summary(spark, sf_dir).where("type is not null")
    body = F.to_json(F.struct("confirmed", "dismissed", F.lit(1).alias("reportVersion"), "type"))
    log = ledger.chained(d.select(F.col("type").alias("job_id"), F.lit(1).alias("seq"), F.sha2(ledger.canonical_json(body), 256).alias("statement_hash")))
    return log.select("job_id", F.col("statement_hash").alias("report_hash"), F.col("seq").alias("ledger_seq"), F.col("entry_hash").alias("ledger_entry"))


def q_invalid_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumns({"payload_hash": F.when(F.col("seq") % 5 == 0, F.upper("payload_hash")).otherwise(F.col("payload_hash")), "kind": F.when(F.col("seq") % 7 == 0, "unknown").otherwise(F.col("kind"))})
    return ledger.constraint_violations(e).select("job_id", "seq", "problem")


def q_chain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logs as one list by job and number."""
    return numbered_globally(adapters.ledger_turns(spark, sf_dir), "place", F.col("job_id"), F.col("seq"))


def q_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs driven by their messages; messages that their state does not allow are counted."""
    e = adapters.table(spark, sf_dir, "events")
    word = F.create_map(*[F.lit(x) for kv in {"view": "queue", "click": "start", "purchase": "finish", "error": "fail", "signup": "cancel"}.items() for x in kv])
    return ledger.job_states(e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("n"), F.coalesce(word[F.col("event_type")], F.lit("queue")).alias("message")))


# --- scalar rules ------------------------------------------------------------------------


def q_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number, exact ties among them, in four languages' rounding to two decimals."""
    e = adapters.table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, (F.col("event_id") % 1000) / 8.0).otherwise((F.col("event_id") % 1000) / 200.0)
    return e.select("event_id", rounding.python_round(x, 2).alias("python"), rounding.go_round(x, 2).alias("go"), rounding.to_fixed(x, 2).alias("to_fixed"), rounding.math_round(x).cast("bigint").alias("math_round"))


def q_motion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion character, camera motion, shift texts and names of each frame."""
    s = adapters.signal(spark, sf_dir)
    k = F.col("raw_bg").cast("int")
    flow = F.col("raw_flow") / 10
    z = (k % 40 - 15) / 2.0
    return s.select(
        "frame_idx", scalars.motion_character((k % 100) / 100.0).alias("character"), scalars.camera_motion(flow, F.col("raw_diff") / 10, k % 3 > 0).alias("camera_motion"),
        scalars.z_text(F.when(k % 40 != 15, z).otherwise(0.0)).alias("z_text"), scalars.title(F.concat(F.lit("snake_case_"), k.cast("string"))).alias("title"), scalars.abbreviated(F.sha2(k.cast("string"), 256)).alias("short_hash"),
        scalars.utc_seconds_text(F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))).alias("at"), scalars.short_clock(F.col("t") % 5000).alias("clock"),
        reporting.display_name(F.element_at(F.array(*map(F.lit, ("loitering", "head_turn", "other"))), k % 3 + 1)).alias("shown"), scalars.relative_path(F.concat(F.lit("/data/pipeline_out/"), k.cast("string"), F.lit("/pipeline_out/x.jpg")), "pipeline_out/").alias("path"),
    )


def q_box_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded crops, whether they are large enough to be judged, and boxes that show one subject twice."""
    b = object_queries.numbered(spark, sf_dir)
    crop = geometry.padded(box(), 0.35, 660, 400)
    sizes = b.groupBy("frame_idx").agg(F.count_if(geometry.area(crop) >= 6400).alias("judgeable"), F.sum(geometry.area(crop)).cast("bigint").alias("pixels"))
    twice = spatial.box_pairs(b, ["frame_idx"]).where(geometry.same_subject(box("a_"), box("b_"))).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("duplicates"))
    centre = geometry.weighted_centre()
    whole = b.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2"))).alias("boxes")).select("frame_idx", rounding.go_round(centre[0], 6).alias("cx"), rounding.go_round(centre[1], 6).alias("cy"))
    return sizes.join(twice, "frame_idx", "left").join(whole, "frame_idx").fillna({"duplicates": 0})


def q_relevant_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = object_queries.numbered(spark, sf_dir)
    return b.where(rois.relevant(box(), F.col("cls"), F.col("conf"), object_queries.FRAME_H)).select("box_id", "cls")


def q_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to a map and back: counts by type of each video, as a map's entries."""
    e = adapters.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = e.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return maps.select("video_id", F.explode("m").alias("type", "n"))


def q_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next number of a linear congruential generator, and its share of the range."""
    e = adapters.table(spark, sf_dir, "events")
    n = scalars.lcg(F.col("event_id"))
    return e.select("event_id", n.alias("n"), F.round(n / 0x7FFFFFFF, 9).alias("share"))


def q_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the batch of their log's first two statements, and those that wait for one."""
    s = adapters.ledger_turns(spark, sf_dir).withColumnRenamed("statement_hash", "entry_hash")
    log = ledger.anchored(s, ledger.batches(s.where("seq <= 2")), F.concat(F.lit("ref/"), F.col("job_id").cast("string")))
    return log.select("job_id", "seq", "anchor_root", "anchor_ref")


def q_entry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entry_documents(entries(spark, sf_dir))


def q_small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active samples, known profiles, stamped names, and boxes of which some are malformed."""
    e = adapters.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.element_at(F.array(*map(F.lit, [*scalars.PROFILES, "toString"])), k % 6 + 1)
    edges = F.slice(F.array(k, k + 1, k + 20, k + 30), 1, F.when(k % 5 == 0, 3).otherwise(4))
    b = geometry.box_of(edges)
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", (F.col("value") >= 5).alias("active"), scalars.one_of(name, scalars.PROFILES).alias("known"), scalars.stamped_name(ts, F.col("event_type")).alias("stamped"), scalars.day_text(ts).alias("day"), geometry.area(b).alias("area"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_T = object_queries._T  # boxes with times and ids
_RICH = ctes("boxes", "event_set") + """, rich as (select event_id, video_id, start, start + event_id % 600 as "end", motion as peak, motion / 2 as mean, 1 - camera_share as seen, camera_share, event_id % 50 + 1 as frames, persons, phones > 1 as phone, papers > 1 as paper, (event_id * 31 % 1000) / 1000.0::double as jerk,
    case when round((event_id * 31 % 1000) / 1000.0::double, 4) >= 0.6 then 'sudden' else 'gradual' end as character, case when persons > 0 then event_id % 97 end as track_id, case when event_id % 3 = 0 then 'clips/' || event_id end as clip from event_set)"""
_FOUND = """, found as (select box_id as finding_id, frame_idx as event_id, video_id, case when cls = 'book' then 'object_exchange' else 'prohibited_object' end as type, case cls when 'book' then 'paper/chit' else 'mobile phone' end || ' detected' as label, track_id, t + roi_id * 3 as start_sec, conf as confidence, filled > 0.07 as suppressed from nt where cls <> 'person' and conf >= 0.35)"""
_FINDINGS = _T + _FOUND
_BOTH = _T + _RICH[len(ctes("boxes")):] + _FOUND
_SHAKE = ctes("signal") + """, sh as (select *, k % 4 = 0 as flow_flag, k % 6 < 2 as shake_flag, case when k % 5 < 3 then 'masked' when k % 5 = 3 then 'unmasked_fallback' else 'cold_start' end as mode, (k % 25)::double * ((k % 10) / 10.0::double) as shake_score, raw_diff as blur from signal),
    tr as (select *, shake_flag and mode = 'masked' as trusted, shake_score * case when mode = 'masked' then 1.0::double else 0.3::double end as shake_for_q, flow_flag or (shake_flag and mode = 'masked') as camera_motion from sh)"""
_ENTRIES = """with e as (select conv_id as job_id, (turn + 1)::int as seq, turn, case when turn % 2 = 0 then 'artifact_derived' else 'verdict_recorded' end as kind, 'file/' || (turn % 4) as subject, case when turn % 3 > 0 then role end as actor_id, sha256(coalesce(text, '')) as payload_hash from conversations)"""
_CHAIN, _BASE = review_queries._CHAIN, review_queries._BASE

#: Each finding's frame, and the best still that the listing has for it.
_STILLS = """, ff as (select *, case when finding_id % 4 = 0 then 0 else event_id end as at_frame from found),
    fs as (select *, case when event_id % 7 = 0 and at_frame = event_id then '/job/out/snapshots/event' || event_id || '_f' || printf('%07d', event_id) || '.jpg'
        when event_id % 5 = 0 then '/job/out/annotated/annotated_frame_' || printf('%07d', event_id) || '.jpg'
        when event_id % 3 = 0 then '/job/frames/cam' || video_id || '__f' || printf('%07d', event_id) || '__t1.5.jpg' end as still from ff)"""

ORACLE_SQL = {
    "q_api_events": _RICH + """ select 'event-' || event_id as id, video_id, start, "end", "end" - start as duration, peak as motion_score, camera_share as camera_shake, case when phone or peak > 0.7 then 'high' when persons > 0 or peak > 0.4 then 'medium' else 'low' end as priority,
        case when phone then 'phone_activity' when paper then 'paper_activity' when persons > 1 then 'proximity' when camera_share > 0.5 then 'camera_motion' else 'unusual_motion' end as type,
        case when phone then 'Person detected with cell phone (' || persons || ' tracks, ' || printf('%.1f', peak * 100) || '% motion)' when persons > 1 then 'Multiple persons detected in proximity (' || persons || ' tracks)' when persons = 1 then 'Person detected with unusual motion (score: ' || printf('%.2f', peak) || ')'
            else 'Motion detected (score: ' || printf('%.2f', peak) || ', observability: ' || printf('%.2f', seen) || ')' end as description,
        coalesce(track_id::varchar, 'N/A') as track_id, coalesce(clip, '') as clip_url, case when phone then 'person with phone' else 'person' end as object, mean as confidence, seen as observability, 1.0::double - seen as lighting,
        concat_ws('; ', 'Motion score: ' || printf('%.2f', peak) || ' (peak), ' || printf('%.2f', mean) || ' (mean)', 'Observability: ' || printf('%.2f', seen), 'Frames analyzed: ' || frames, case when persons > 0 then 'Person tracks detected: ' || persons end, case when phone then 'Cell phone detected in frame' end, case when paper then 'Paper/book detected in frame' end,
            case when camera_share > 0.3 then 'Possible camera motion: ' || printf('%.1f', camera_share * 100) || '% of frames' end, case when character = 'sudden' then 'Sudden onset detected (jerk saliency: ' || printf('%.2f', jerk) || ') — abrupt, non-periodic motion rather than gradual movement' end) as evidence, persons as person_count from rich""",
    "q_video_quality": _RICH + " select video_id, round(avg(seen), 9) as observability, round(avg(camera_share), 9) as camera_shake, count(*) as events from rich group by 1",
    "q_explanation_rows": _BOTH + """, cv as (select event_id, 'camera_shake: ' || case when camera_share > 0.6 then 'high' when camera_share >= 0.3 then 'medium' else 'low' end as caveat from rich)
        select event_id, case when track_id % 3 = 0 then label when track_id % 5 = 0 then label || ' (region r0c' || (track_id % 4) || ' was within its normal range)' else label || ' (region r0c' || (track_id % 4) || ' was ' || (track_id % 5) || '.0 sigma above its own baseline)' end as claim, start_sec as at, track_id, caveat from found join cv using (event_id)
        union all select event_id, 'Motion peaked at ' || printf('%.2f', peak) || ' over ' || frames || ' analysed frames (' || character || ' onset)', start, null, caveat from rich join cv using (event_id)""",
    "q_stills": _FINDINGS + _STILLS + " select finding_id, still from fs",
    "q_grounded_claims": _BOTH + _STILLS + """, cv as (select event_id, 'camera_shake: ' || case when camera_share > 0.6 then 'high' when camera_share >= 0.3 then 'medium' else 'low' end as caveat from rich),
        roi as (select event_id, case when event_id % 2 = 0 then concat_ws(',', event_id % 7, event_id % 5, event_id % 97, event_id % 89) end as roi from rich)
        select event_id, label as claim, start_sec as at, track_id, roi, case when finding_id % 3 = 0 then concat_ws(',', finding_id % 7, finding_id % 5, finding_id % 97, finding_id % 89) end as box,
            '/api/frame?idx=' || at_frame || coalesce(' /api/snapshot?path=' || still, '') as urls, caveat
        from fs join cv using (event_id) join roi using (event_id)
        union all select event_id, 'Motion peaked at ' || printf('%.2f', peak) || ' over ' || frames || ' analysed frames (' || character || ' onset)', start, null, roi, null, '/api/frame?idx=' || event_id, caveat from rich join cv using (event_id) join roi using (event_id)""",
    "q_finding_explanations": _FINDINGS + " select a.finding_id, count(b.label) as claims, min(b.start_sec) as first_at from found a left join found b on a.event_id = b.event_id and abs(b.start_sec - a.start_sec) < 4 group by 1",
    "q_findings_sorted": _FINDINGS + " select finding_id, video_id, row_number() over (partition by video_id order by start_sec, finding_id) as by_time, row_number() over (partition by video_id order by confidence desc, finding_id) as by_confidence, row_number() over (partition by video_id order by type, start_sec, finding_id) as by_type from found",
    "q_capped": _FINDINGS + " select finding_id, row_number() over (partition by video_id order by event_id, finding_id) <= 4 as taken, greatest(0, count(*) over (partition by video_id) - 4) as omitted from found",
    "q_report_sets": ctes("review") + """ select coalesce(verdict = 'confirmed', false) as confirmed, coalesce(verdict = 'dismissed', false) as dismissed, n_chars < 50 as auto_filtered, verdict is null and n_chars >= 50 as unreviewed, count(*) as findings from documents left join (select doc_id, verdict from review) using (doc_id) group by all""",
    "q_suppressed": _FINDINGS + """, i as (select *, row_number() over (partition by video_id order by event_id, finding_id) <= 40 as taken from found)
        select video_id, count(*) as findings, count(*) filter (taken and confidence < 0.5) as suppressed, max(case when taken and confidence < 0.5 then 'caption contradicts ' || type end) as reason, count(*) filter (not taken) as unjudgeable from i group by 1""",
    "q_shake_trust": _SHAKE + " select frame_idx, trusted, round(shake_for_q, 6) as shake_for_q, camera_motion from tr",
    "q_quality_sources": _SHAKE + """ select video_id, count(*) as frames, count(*) filter (flow_flag and not shake_flag) as flow_only, count(*) filter (shake_flag and not flow_flag) as shake_only, count(*) filter (flow_flag and shake_flag) as both, count(*) filter (shake_flag) as raw_shake, count(*) filter (trusted) as trusted_shake,
        count(*) filter (shake_flag and not trusted) as untrusted_shake, count(*) filter (camera_motion) as camera_motion_frames, count(*) filter (mode = 'masked') as masked, count(*) filter (mode = 'unmasked_fallback') as unmasked_fallback, count(*) filter (mode = 'cold_start') as cold_start, round(100 * (count(*) filter (camera_motion)) / count(*)::double, 1) as camera_motion_pct from tr group by 1""",
    "q_quality_spread": _SHAKE + " select video_id, round(min(shake_score), 4) as min_shake_score, round(max(shake_score), 4) as max_shake_score, round(median(shake_score), 4) as median_shake_score, round(min(blur), 4) as min_blur, round(max(blur), 4) as max_blur, round(median(blur), 4) as median_blur from tr group by 1",
    "q_mask_cleanup": """with m as (select l_suppkey % 10 as video_id, l_partkey % 100 * 50 as b, l_orderkey % 97 * 60 as a from lineitem),
        p as (select *, round(case when b > 0 then greatest(0, (b - a) / b::double) * 100 else 0 end, 2) as noise, round(case when b > 0 then greatest(0, (a - b) / b::double) * 100 else 0 end, 2) as gaps from m)
        select video_id, count(*) as masks, sum(b)::bigint as before_px, sum(a)::bigint as after_px, round(avg(noise), 2) as noise_removed_pct, round(avg(gaps), 2) as gaps_filled_pct from p group by 1""",
    "q_dashboard_tiles": _BOTH + """, e as (select count(distinct video_id) as videos, count(*) as events, count(*) filter (phone or peak > 0.7) as high_priority from rich), f as (select count(*) filter (not suppressed) as findings, count(distinct case when confidence > 0.6 then finding_id end) as reviewed from found)
        select *, case when findings > 0 then floor(reviewed / findings::double * 100 + 0.5)::bigint else 0 end as reviewed_pct from e, f""",
    "q_events_with_detections": _BOTH + " select video_id, count(*) as events, count(*) filter (event_id in (select event_id from found)) as with_detections from rich group by 1",
    "q_event_regions": object_queries._B + """, f as (select o_custkey * 10 + o_orderkey % 10 as event_id, o_orderkey as frame_idx from orders)
        select event_id, count(distinct frame_idx) as frames, count(roi_id) as regions, coalesce(string_agg(roi_id::varchar, ',' order by frame_idx, roi_id, x1, y1), '') as numbers from f left join nb using (frame_idx) group by 1""",
    "q_first_seen": _T + ", f as (select video_id, track_id, min((t, box_id)) as seen from nt group by 1, 2) select video_id, string_agg(track_id::varchar, ',' order by seen) as tracks from f group by 1",
    "q_by_position": ctes("signal") + """, a as (select video_id, frame_idx, row_number() over (partition by video_id order by frame_idx) as n from signal), b as (select o_custkey as video_id, o_orderkey as source_idx, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
        select video_id, frame_idx, source_idx from a left join b using (video_id, n)""",
    "q_invalid_frames": ctes("signal") + " select video_id, case when k % 7 = 0 then 'missing' when k % 13 <= 0 then 'empty' when k % 11 = 0 then 'channels' when floor(raw_diff / 5) = 0 then 'blank' else 'valid' end as why, count(*) as frames from signal group by all",
    "q_fleet_search": _BASE + """, si as (select 'C' || (camera % 60) as site, arg_min(verdict, severity) as worst, min(severity) as sev, count(*) filter (verdict not in ('stable', 'no_baseline')) as problems from report group by 1)
        select site, worst, problems from si where contains(site, '1') and problems > 0 order by sev, site limit 30""",
    "q_sites_ordered": ctes("activity") + ", c as (select distinct 'C' || (camera % 9) as site, 'cam' || camera as camera from activity) select *, row_number() over (order by site collate en, camera collate en) as place from c",
    "q_names_collated": "with w as (select regexp_extract(text, '(\\p{L}+)', 1) as name from documents), n as (select name, lower(name) as l from w where name <> ''), a as (select l, count(*) as alike from n group by l), d as (select distinct name, l from n) select name, alike, row_number() over (order by name collate en, name) as place from d join a using (l)",
    "q_events_ordered": _RICH + " select event_id, start, row_number() over (order by start, event_id) as place from rich",
    "q_drift_summary": _BASE + ", r as (select *, row_number() over (partition by camera order by shift desc, region) as n from sh) select camera, count(*) as compared, count(*) filter (shift > 0.6) as shifted, round(count(*) filter (shift > 0.6) / count(*)::double, 6) as share, max(shift) as peak, string_agg(case when n <= 3 then region end, ',' order by n) as worst from r group by 1",
    "q_camera_status": _BASE + " select p.camera, count(*) as regions, sum(samples)::bigint as samples, coalesce(any_value(r.verdict), 'none') as verdict from p left join (select * from report where regions_compared > 4) r using (camera) group by 1",
    "q_statement_hash": _ENTRIES + """ select 'job' || job_id as job_id, seq, sha256('{"actorId":' || coalesce('"' || actor_id || '"', 'null') || ',"jobId":"job' || job_id || '","kind":"' || kind || '","payload":{"a":[1.5,null],"turn":' || turn || '},"payloadHash":"' || payload_hash || '","subject":"' || subject || '","timestamp":"2024-01-01T00:00:00Z"}') as statement_hash from e""",
    "q_ledger_batch": review_queries._MERKLE + ", sp as (select job_id, min(seq) as from_seq, max(seq) as to_seq, count(*) as entries from ledger group by 1) select job_id, h as root, from_seq, to_seq, entries from lv join sp using (job_id) where lv.n = 1",
    "q_split_chain": _CHAIN + " select job_id, count(*) filter (job_id % 3 = 0 and seq > 2) as orphaned, count(*) filter (job_id % 3 = 0 and seq > 2) > 0 as split, count(*) filter (job_id % 3 = 0 and seq > 2) = 0 as ok from links group by 1",
    "q_append_only": _CHAIN + " select job_id, seq, case when job_id % 10 = 0 then 'deleted' else 'altered' end as problem from links where seq = 2 and job_id % 10 in (0, 3)",
    "q_artifact_hashes": _ENTRIES + " select job_id, subject, arg_max(payload_hash, seq) as payload_hash from e where kind = 'artifact_derived' group by 1, 2",
    "q_unanchored": _ENTRIES + " select job_id, count(*) as waiting, min(seq) as first from e where seq > 2 group by 1",
    "q_report_issue": "with r as (" + review_queries.ORACLE_SQL["q_report_summary"].replace("with recursive", "with") + """), h as (select type as job_id, sha256('{"confirmed":' || confirmed || ',"dismissed":' || dismissed || ',"reportVersion":1,"type":"' || type || '"}') as report_hash from r where type is not null)
        select job_id, report_hash, 1 as ledger_seq, sha256('1:1|64:' || repeat('0', 64) || '|64:' || report_hash) as ledger_entry from h""",
    "q_invalid_entries": _ENTRIES + " select job_id, seq, 'kind' as problem from e where seq % 7 = 0 union all select job_id, seq, 'payload_hash' from e where seq % 5 = 0 and not regexp_matches(upper(payload_hash), '^[0-9a-f]{64}$')",
    "q_chain_scan": ctes("ledger") + " select *, row_number() over (order by job_id, seq) as place from ledger",
    "q_job_states": """with recursive m as (select user_id as job_id, case event_type when 'view' then 'queue' when 'click' then 'start' when 'purchase' then 'finish' when 'error' then 'fail' when 'signup' then 'cancel' else 'queue' end as message, row_number() over (partition by user_id order by ts, event_id) as n from events),
        w as (select job_id, n, case when message = 'queue' then 'queued' end as state, (message = 'queue')::int as taken from m where n = 1
          union all select m.job_id, m.n, coalesce(s, w.state), (s is not null)::int from w join m on m.job_id = w.job_id and m.n = w.n + 1, lateral (select case when message = 'queue' and coalesce(w.state, 'done') in ('done', 'error', 'cancelled') then 'queued' when w.state = 'queued' and message = 'start' then 'processing' when w.state = 'queued' and message = 'cancel' then 'cancelled'
            when w.state = 'processing' and message = 'finish' then 'done' when w.state = 'processing' and message = 'fail' then 'error' end as s))
        select job_id, arg_max(coalesce(state, ''), n) as state, sum(taken)::bigint as accepted, sum(1 - taken)::bigint as refused from w group by 1""",
    "q_rounding": """with x as (select event_id, case event_id % 3 when 0 then value when 1 then (event_id % 1000) / 8.0::double else (event_id % 1000) / 200.0::double end as x from events)
        select event_id, printf('%.2f', x)::double as python, sign(x) * floor(abs(x) * 100 + 0.5) / 100 as go, case when abs(x * 100 * 2) % 2 = 1 then floor(x * 100 + 0.5) / 100 else printf('%.2f', x)::double end as to_fixed, floor(x + 0.5)::bigint as math_round from x""",
    "q_motion_rules": ctes("signal") + """ select frame_idx, case when round((k % 100) / 100.0::double, 4) >= 0.6 then 'sudden' else 'gradual' end as character,
        case when raw_flow / 10 < 0.5 then false when k % 3 > 0 then raw_diff / 10 > 0 and raw_flow / 10 >= 0.8 * (raw_diff / 10) else raw_flow / 10 >= 1.0 end as camera_motion,
        case when k % 40 = 15 then 'normal' when abs((k % 40 - 15) / 2.0::double) >= 10 then 'not meaningful' else printf('%.1f', (k % 40 - 15) / 2.0::double) || ' sigma' end as z_text, 'Snake Case ' || k as title, left(sha256(k::varchar), 2) || '********' as short_hash,
        strftime(make_timestamp((t * 1000000)::bigint), '%Y-%m-%dT%H:%M:%SZ') as at, printf('%d:%02d', floor((t % 5000) / 60)::int, floor((t % 5000) % 60)::int) as clock, case k % 3 when 0 then 'Loitering' when 1 then 'Head Turn' else 'other' end as shown, 'pipeline_out/' || k || '/pipeline_out/x.jpg' as path from signal""",
    "q_box_rules": object_queries._PAIRS + """, cr as (select frame_idx, greatest(0, trunc(x1 - (x2 - x1) * 0.35::double)::int) as a, greatest(0, trunc(y1 - (y2 - y1) * 0.35::double)::int) as b, least(660, trunc(x2 + (x2 - x1) * 0.35::double)::int) as c, least(400, trunc(y2 + (y2 - y1) * 0.35::double)::int) as d, (x2 - x1) * (y2 - y1) as s, (x1 + x2) / 2.0::double as mx, (y1 + y2) / 2.0::double as my from nb),
        du as (select a.frame_idx, count(*) as duplicates from nb a join nb b on a.frame_idx = b.frame_idx and a.box_id < b.box_id and greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) > 0.5 * least((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1)) group by 1)
        select frame_idx, count(*) filter (greatest(0, c - a) * greatest(0, d - b) >= 6400) as judgeable, sum(greatest(0, c - a) * greatest(0, d - b))::bigint as pixels, coalesce(any_value(duplicates), 0) as duplicates, round(sum(mx * s) / sum(s), 6) as cx, round(sum(my * s) / sum(s), 6) as cy from cr left join du using (frame_idx) group by 1""",
    "q_relevant_detections": object_queries._B + """, o as (select *, (y2 <= 40 or y1 >= 368 or (x2 - x1) * (y2 - y1) < 250 or (cls = 'cell phone' and (x2-x1)::double/(y2-y1) > 0.80 and (x2-x1)::double/(y2-y1) < 1.25)) as overlay from nb) select box_id, cls from o where cls = 'person' or (conf >= 0.35 and not overlay)""",
    "q_map_rows": "select user_id as video_id, event_type as type, count(*) as n from events group by 1, 2",
    "q_anchored": review_queries._MERKLE.replace("from ledger\n", "from ledger where seq <= 2\n") + ", r as (select job_id, h as root, max(to_seq) over (partition by job_id) as to_seq from lv join (select job_id, max(seq) as to_seq from ledger where seq <= 2 group by 1) using (job_id) where n = 1) select l.job_id, seq, case when seq <= to_seq then root end as anchor_root, case when seq <= to_seq then 'ref/' || l.job_id end as anchor_ref from ledger l left join r using (job_id)",
    "q_entry_documents": _ENTRIES + """ select job_id, seq, '{"seq":' || seq || ',"kind":"' || kind || '","subject":"' || subject || '","jobId":' || job_id || ',"actorId":' || coalesce('"' || actor_id || '"', 'null') || ',"timestamp":"2024-01-01T00:00:00Z","payloadHash":"' || payload_hash || '"}' as entry from e""",
    "q_small_rules": """with e as (select *, cast(json_extract_string(props, '$.k') as int) as k from events) select event_id, value >= 5 as active, k % 6 < 5 as known, (epoch_us(ts) // 1000) || '_' || event_type as stamped, strftime(ts, '%-d %b %Y, %H:%M') as day, case when k % 5 <> 0 then 20 * 29 else 0 end as area from e""",
    "q_lcg": "select event_id, (event_id * 1103515245 + 12345) & 2147483647 as n, round(((event_id * 1103515245 + 12345) & 2147483647) / 2147483647::double, 9) as share from events",
}
