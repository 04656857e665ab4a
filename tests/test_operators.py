"""Operators against hand-made cases and plain Python."""

import cmath
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import geometry, scalars
from eventide.operators import drift, findings, graph, jerk, ledger, poses, review, scans, segment, tracks, windows
from eventide.sources import readers, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def segmented(series, th):
    """The sequential reading of segmentation, for one video."""
    events, start = [], None
    for t, s in series:
        if start is None and s >= th.start:
            start = t
        elif start is not None and s < th.end:
            events.append([start, t])
            start = None
    end = series[-1][0]
    if start is not None:
        events.append([start, end])
    merged = []
    for s, e in events:
        if merged and s - merged[-1][1] <= th.merge_gap:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    out, full = [], []
    for s, e in merged:
        if e - s < th.min_duration:
            out.append(("short_motion", s, e, s, e, 0))
        else:
            full.append([max(0.0, s - th.padding), min(end, e + th.padding), s, e, 0])
    joined = []
    for p in full:
        if joined and p[0] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], p[1])
            joined[-1][3] = max(joined[-1][3], p[3])
            joined[-1][4] += 1
        else:
            joined.append(p)
    return sorted(out + [("full_event", *p) for p in joined])


def test_segment_is_the_loop(spark):
    random.seed(1)
    th = segment.Thresholds(start=0.6, end=0.3, min_duration=3.0, merge_gap=2.0, padding=2.5)
    data, want = [], []
    for v in range(30):
        series = [(float(t), random.random() ** 1.5) for t in range(60)]
        data += [(v, i, t, s) for i, (t, s) in enumerate(series)]
        want += [(v, *e) for e in segmented(series, th)]
    found = segment.segment(spark.createDataFrame(data, "video_id int, frame_idx int, t double, s_final double"), th)
    assert rows(found, "video_id", "kind", "start", "end", "unpadded_start", "unpadded_end", "merges") == sorted(want)


def test_segment_of_nothing(spark):
    empty = spark.createDataFrame([], "video_id int, frame_idx int, t double, s_final double")
    assert segment.segment(empty).count() == 0


def test_latch_needs_ordered_bounds():
    with pytest.raises(ValueError):
        scans.latched(None, F.col("x"), 0.1, 0.2)


def test_interval_join_keeps_both_ends(spark):
    points = spark.createDataFrame([(1, float(t)) for t in range(10)], "v int, t double")
    spans = spark.createDataFrame([(1, "a", 2.0, 4.0), (1, "b", 4.0, 4.0), (1, "c", 9.0, 3.0), (2, "d", 0.0, 9.0)], "v int, name string, start double, end double")
    out = windows.interval_join(points, spans, ["v"], "t", "start", "end", 1.5)
    assert rows(out, "name", "t") == [("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 4.0)]


def test_boxes(spark):
    b = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15), (0, 0, 10, 10, 10, 10, 20, 20), (0, 0, 0, 0, 0, 0, 0, 0)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    a, c = geometry.box("a_"), geometry.box("b_")
    got = b.select(F.round(geometry.iou(a, c), 4), geometry.edge_distance(a, c), geometry.touches(a, c)).collect()
    assert [tuple(r) for r in got] == [(0.1429, 0.0, True), (0.0, 0.0, True), (0.0, 0.0, True)]


def test_region_of_a_corner(spark):
    r = spark.range(1).select(geometry.region_id(F.lit(640.0), F.lit(480.0), 640, 480), geometry.region_id(F.lit(-3.0), F.lit(0.0), 640, 480)).first()
    assert tuple(r) == ("r2c3", "r0c0")


@pytest.mark.parametrize(("box", "roi", "stills", "claim", "want"), [(True, False, 1, "x", "full"), (False, True, 0, "x", "spatial"), (False, False, 2, "x", "temporal"), (False, False, 0, "x", None), (True, True, 1, "  ", None)])
def test_grounding(spark, box, roi, stills, claim, want):
    assert spark.range(1).select(scalars.grounding(F.lit(box), F.lit(roi), F.lit(stills), F.lit(claim))).first()[0] == want


def test_dominant_takes_the_first_of_equals(spark):
    pick = lambda **b: spark.range(1).select(scalars.dominant({k: F.lit(v) for k, v in b.items()})).first()[0]
    assert pick(shake="medium", light="medium", blur="unavailable") == "shake: medium"
    assert pick(shake="low", light="high") == "light: high"
    assert pick(shake="unavailable") == "unavailable"


POSE = "video_id int, frame_idx int, t double, box_id int, x1 double, y1 double, x2 double, y2 double, " + ", ".join(f"{j}_{a} double" for j in ("nose", "ls", "rs", "lw", "rw", "lh", "rh") for a in "xyc")


def pose(i, lift=0.0, nose=0.5, step=0.0, shoulders=0.9, right_lift=None):
    """A person with shoulders 40 apart at height 200, whose wrists are ``lift`` shoulder widths over them."""
    x = 100.0 + i * step
    joints = {"nose": (x + 40 * nose, 180.0, 0.9), "ls": (x, 200.0, shoulders), "rs": (x + 40, 200.0, 0.9), "lw": (x, 200 - 40 * lift, 0.7), "rw": (x + 40, 200 - 40 * (lift if right_lift is None else right_lift), 0.8), "lh": (x, 260.0, 0.2), "rh": (x + 40, 264.0, 0.9)}
    return (1, i, i / 5, i, x - 10, 150.0, x + 50, 300.0, *(v for j in joints.values() for v in j))


def measured(spark, rows):
    return poses.measured(spark.createDataFrame(rows, POSE))


@pytest.mark.parametrize(("raised", "step", "found"), [(4, 0, 1), (1, 0, 0), (2, 0, 0), (3, 0, 1), (6, 30, 0), (6, 2, 1), (0, 0, 0)])
def test_hand_raises(spark, raised, step, found):
    got = poses.hand_raises(measured(spark, [pose(i, 0.5 if i < raised else -1.0, step=step) for i in range(8)]), ["video_id"]).collect()
    assert len(got) == found
    if found:
        assert got[0]["end"] > got[0]["start"] and got[0]["confidence"] == 0.7


def test_a_gap_ends_a_raise(spark):
    lifts = [0.5, 0.5, None, 0.5, 0.5]
    rows_ = [pose(i, x or 0.0, shoulders=0.1 if x is None else 0.9) for i, x in enumerate(lifts)]
    assert poses.hand_raises(measured(spark, rows_), ["video_id"]).count() == 0


def test_pose_measures(spark):
    high, low, none = measured(spark, [pose(0, 0.25, right_lift=0.75), pose(1, 0.5), pose(2, 0.5, shoulders=0.1)]).orderBy("frame_idx").collect()
    assert (high["lift"], high["lift_conf"], high["torso"], high["yaw"]) == (0.75, 0.8, 64.0, 0.0)
    assert (low["lift"], low["lift_conf"]) == (0.5, 0.7)  # the left one of equals
    assert none["lift"] is None and none["yaw"] is None and none["torso"] is None


def test_head_turns(spark):
    turned = [0.5] * 6 + [0.9] * 5 + [0.5] * 3
    for step, found in ((0, 1), (30, 0)):
        got = poses.head_turns(measured(spark, [pose(i, nose=n, step=step) for i, n in enumerate(turned)]), ["video_id"]).collect()
        assert len(got) == found
    # a run that is closed is held against the base, one that is open against 0
    assert [r["direction"] for r in poses.head_turns(measured(spark, [pose(i, nose=0.2 if i < 6 else 0.45 if i < 11 else 0.2) for i in range(14)]), ["video_id"]).collect()] == ["right"]
    assert [r["direction"] for r in poses.head_turns(measured(spark, [pose(i, nose=0.2 if i < 9 else 0.45) for i in range(14)]), ["video_id"]).collect()] == ["left"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_auc_is_the_pair_form(spark):
    random.seed(3)
    data = [("x", round(random.random(), 1), random.choice(["confirmed", "dismissed"])) for _ in range(60)] + [("y", 0.5, "confirmed")]
    got = {r["type"]: r["auc"] for r in review.separability(spark.createDataFrame(data, "type string, confidence double, verdict string")).collect()}
    c, d = [[v for t, v, k in data if t == "x" and k == kind] for kind in ("confirmed", "dismissed")]
    want = sum((a > b) + 0.5 * (a == b) for a in c for b in d) / (len(c) * len(d))
    assert got == {"x": round(want, 3), "y": 0.5}


def test_fold_copies_one_sided_regions(spark):
    schema = "camera int, region string, mu double, sigma double, samples long"
    p = spark.createDataFrame([(1, "a", 1.0, 0.5, 10), (1, "b", 2.0, 0.1, 5)], schema)
    s = spark.createDataFrame([(1, "a", 3.0, 0.5, 30), (1, "c", 7.0, 0.2, 4)], schema)
    got = {r["region"]: (r["mu"], round(r["sigma"], 4), r["samples"]) for r in drift.folded(p, s).collect()}
    assert got == {"a": (2.5, 1.0, 40), "b": (2.0, 0.1, 5), "c": (7.0, 0.2, 4)}


def statements(spark, n):
    return spark.createDataFrame([(1, i + 1, f"{i:064x}") for i in range(n)], "job_id int, seq int, statement_hash string")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17])
def test_merkle_proofs(spark, n):
    s = statements(spark, n)
    roots = ledger.merkle_roots(s, data="statement_hash")
    held = ledger.proofs_hold(s, ledger.merkle_proofs(s, data="statement_hash"), roots, data="statement_hash").collect()
    assert len(held) == n and all(r["ok"] for r in held)


def test_chain_finds_each_kind_of_change(spark):
    s = statements(spark, 6)
    log = ledger.chained(s)
    assert ledger.problems(log, s).count() == 0
    assert ledger.problems(log.orderBy(F.rand(1)), s).count() == 0  # order of rows is no tampering
    edited = log.withColumn("statement_hash", F.when(F.col("seq") == 3, "0" * 64).otherwise(F.col("statement_hash")))
    assert rows(ledger.problems(edited, s), "seq", "problem") == [(3, "entry_hash_mismatch"), (3, "statement_altered")]
    gone = log.where("seq <> 3")
    assert ("sequence_gap" in {r["problem"] for r in ledger.problems(gone).collect()}) and (4, "broken_link") in rows(ledger.problems(gone), "seq", "problem")
    more = ledger.appended(log, statements(spark, 2))
    assert ledger.problems(log.unionByName(more)).count() == 0


def test_canonical_json():
    assert ledger.canonical({"b": 1, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'
    assert ledger.canonical({"v": [1.0, -0.0, 1e-7, 1.5e-9, 0.000001, 123.25, -2.5]}) == '{"v":[1,0,1e-7,1.5e-9,0.000001,123.25,-2.5]}'
    # keys go by UTF-16 units: a pair of surrogates comes before U+FF5E
    assert ledger.canonical({"\uff5e": 1, "\U0001f600": {"z": "\x07\x7f\ud800/"}}) == '{"\U0001f600":{"z":"\\u0007\x7f\\ud800/"},"\uff5e":1}'
    for bad in (float("nan"), 2**53, 1e20, float("inf"), 10**400, {1: 2}, {"x": object()}):
        with pytest.raises(ValueError):
            ledger.canonical(bad)


def test_tracker_confirms_after_three_hits():
    t, box = tracks.Tracker(), np.array([[0.0, 0, 10, 10]])
    assert [t.update(box, i) for i in range(4)] == [[], [], [(0, 1)], [(0, 1)]]
    assert t.update(np.array([[100.0, 0, 110, 10]]), 4) == []


def test_tracked_is_the_plain_loop(spark):
    rng = random.Random(3)
    boxes = [(v, f, v * 1000 + f * 10 + k, x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(5, 40), y + rng.randrange(5, 40)) for v in (1, 2) for f in sorted(rng.sample(range(90), 60)) for k in range(rng.randrange(1, 4))]
    want = []
    for v in (1, 2):
        open_, made = [], 0
        frames = sorted({b[1] for b in boxes if b[0] == v})
        for step, f in enumerate(frames):
            free = [b for b in boxes if b[:2] == (v, f)]
            for t in open_:
                over = [(overlap(t["box"], b[3:]), -i) for i, b in enumerate(free)]
                best, i = max(over, default=(0, 0))
                if best > 0.3:
                    b = free.pop(-i)
                    t.update(box=b[3:], hits=t["hits"] + 1, last=step)
                    if t["hits"] >= 3:
                        want.append((v, f, b[2], f"Track-{t['id']:02d}"))
            for b in free:
                made += 1
                open_.append({"id": made, "box": b[3:], "hits": 1, "last": step})
            open_ = [t for t in open_ if step - t["last"] <= 30]
    df = spark.createDataFrame(boxes, "video_id int, frame_idx int, box_id int, x1 int, y1 int, x2 int, y2 int")
    assert rows(tracks.tracked(df), "video_id", "frame_idx", "box_id", "track") == sorted(want) and want


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0, w) * max(0, h)
    return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def test_suppression(spark):
    d = spark.createDataFrame([(1, 1, "a", 0.9, 0, 0, 10, 10), (1, 2, "a", 0.8, 1, 1, 11, 11), (1, 3, "b", 0.7, 1, 1, 11, 11), (1, 4, "a", 0.6, 50, 50, 60, 60)], "f int, box_id int, cls string, conf double, x1 int, y1 int, x2 int, y2 int")
    assert rows(tracks.suppressed(d, ["f"]), "box_id") == [(1,), (3,), (4,)]


def test_jerk_finds_the_jump():
    series = np.zeros(64)
    series[32:] = 1.0
    assert (jerk.spectral_residual(np.zeros(5)) == 0).all()
    found = jerk.spectral_residual(series)
    assert found.min() == 0 and found.max() == 1


def test_jerk_by_definition():
    x = [math.sin(i / 3) + (i == 20) for i in range(40)]
    n = len(x)
    f = [sum(v * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x)) for k in range(n)]
    log = [math.log(abs(c) + 1e-8) for c in f]
    rest = [log[k] - sum(log[k + d] for d in (-1, 0, 1) if 0 <= k + d < n) / 3 for k in range(n)]
    power = [abs(sum(math.exp(rest[k]) * cmath.exp(1j * (cmath.phase(f[k]) + 2 * math.pi * k * t / n)) for k in range(n)) / n) ** 2 for t in range(n)]
    weight = {d: math.exp(-(d**2) / (2 * 1.5**2)) for d in range(-3, 4)}
    smooth = [sum(w * power[t + d] for d, w in weight.items() if 0 <= t + d < n) / sum(weight.values()) for t in range(n)]
    want = [(v - min(smooth)) / (max(smooth) - min(smooth)) for v in smooth]
    assert jerk.spectral_residual(np.array(x)) == pytest.approx(want, abs=1e-6)


def test_findings_without_a_subject_get_no_box(spark):
    cols = "video_id bigint, type string, label string, track_id bigint, start_sec double, end_sec double, frame_idx bigint, confidence double, x1 bigint, y1 bigint, x2 bigint, y2 bigint, sightings bigint, duration double"
    one = lambda track, frame, x: (1, "t", "l", track, 0.0, 0.0, frame, 0.5, x, x, x, x, None, None)
    found = spark.createDataFrame([one(7, 3, None), one(7, 3, 9), one(None, 3, None), one(8, 3, None)], cols)
    boxes = spark.createDataFrame([(1, 7, 3, 1, 2, 3, 4), (1, 7, 3, 5, 6, 7, 8)], "video_id bigint, track_id bigint, frame_idx bigint, x1 int, y1 int, x2 int, y2 int")
    got = findings.with_subject_box(found, boxes).collect()
    assert sorted((str(r["track_id"]), str(r["x1"])) for r in got) == [("7", "1"), ("7", "9"), ("8", "None"), ("None", "None")]


def test_nothing_is_removed_that_was_not_recorded(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k int")

    def refuse(rows_):
        raise OSError("no ledger")

    with pytest.raises(OSError):
        sinks.pruned(df, str(tmp_path / "x"), df.where("k = 1"), ["k"], refuse)
    assert not (tmp_path / "x").exists()


def test_numbered_globally(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 7919 % 83)
    got = windows.numbered_globally(df, "place", F.desc("v"), F.col("id")).collect()
    assert [r["place"] for r in sorted(got, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 501))
    assert windows.numbered_globally(df.where("false"), "place", F.col("id")).count() == 0


def test_pointers_and_maps(spark, tmp_path):
    assert readers.active_job(spark, str(tmp_path / "none.json"), "d") == "d"
    (tmp_path / "p.json").write_text('{"jobId": "j7"}')
    assert readers.active_job(spark, str(tmp_path / "p.json"), "d") == "j7"
    assert readers.keyed(spark, str(tmp_path / "none.json"), "a bigint, b string").columns == ["key", "a", "b"]
    assert readers.checked_job("job_1") == "job_1"
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            readers.checked_job(bad)
    (tmp_path / "s").mkdir()
    for name in ("v__f0000012__t1.jpg", "other.jpg"):
        (tmp_path / "s" / name).write_bytes(b"x")
    assert [r["frame_idx"] for r in readers.images(spark, str(tmp_path / "s")).collect()] == [12]


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("video_id,frame_idx,t,score\na,1,0.5,0.25\na,x,1.0,\n")
    got = readers.motion(spark, str(tmp_path / "m.csv")).select("frame_idx", "score", "jerk_score").collect()
    assert [tuple(r) for r in got] == [(1, 0.25, None), (None, None, None)]
    names = spark.createDataFrame([("a/v__f0000123__t1.0.jpg", "m_f00042.png"), ("x.jpg", "m_fx.png")], "p string, q string")
    assert [tuple(r) for r in names.select(readers.frame_of(F.col("p")), readers.mask_frame_of(F.col("q"))).collect()] == [(123, 42), (None, None)]
    (tmp_path / "l.jsonl").write_text('{"seq": 1, "entry_hash": "a"}\n\n{broken\n{"seq": 2, "entry_hash": "b"}\n')
    log = readers.ledger(spark, str(tmp_path / "l.jsonl")).collect()
    assert sorted((str(r["seq"]), r["_damaged"]) for r in log) == [("1", None), ("2", None), ("None", "{broken")]
    probe = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","r_frame_rate":"25/1","nb_frames":"0","duration":"4.0"}]}'
    p = readers.probed(spark.createDataFrame([("v", probe), ("w", "{}")], "video_id string, probe string"))
    assert rows(p.where("video_id = 'v'"), "fps", "duration_sec", "frame_count") == [(25.0, 4.0, 100)]
    assert readers.sampled_frames(p).count() == 20


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(sinks.upserted(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.without(old, new, ["k"]), "k") == [(1,)]
    path = str(tmp_path / "t")
    sinks.replaced(old, path, "k")
    sinks.replaced(new, path, "k")
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_csv(old.select("k", F.struct(F.col("v").alias("x")).alias("roi_summary")), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "roi_x"]
