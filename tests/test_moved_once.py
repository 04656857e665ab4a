"""What detectors need of a key's rows is made where the rows have met: no second shuffle, no join with it."""

import os

import pytest

from eventide.operators import detectors, findings
from eventide.operators.tracks import best_sighting, sighted
from eventide.plans import object_queries

SF = "/root/testdata/sf0.001"
BOXES = "video_id bigint, track_id bigint, t double, frame_idx bigint, roi_id int, source_id bigint, box_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, cls string, conf double"


@pytest.fixture(scope="module")
def boxes(spark):
    rows = [(v, k, float(i * 60), 10 * i + v, 1, i % 3, 1, 5, 5, 25, 35, "book", (i % 4) / 4) for v in range(3) for k in range(2) for i in range(6)]
    return spark.createDataFrame(rows, BOXES).repartition(3)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_loitering_brings_its_mean(boxes):
    found = detectors.stationary(boxes, 100.0)
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    rows = found.collect()
    assert len(rows) == 12 and {r["confidence"] for r in rows} == {round((0 + 0.25 + 0.5 + 0.75 + 0 + 0.25) / 6, 8)}
    assert {(r["start"], r["end"]) for r in rows} == {(0.0, 120.0), (120.0, 240.0)}


def test_sightings_are_counted_with_the_best(boxes):
    assert "Join" not in plan(findings.prohibited_objects(boxes))
    rows = sighted(boxes, ["video_id", "cls"]).orderBy("video_id").collect()
    assert [(r["frame_idx"], r["roi_id"], r["conf"], r["x1"], r["y2"], r["start"], r["end"], r["sightings"]) for r in rows] == [(30 + v, 1, 0.75, 5, 35, 0.0, 300.0, 12) for v in range(3)]
    assert "sightings" not in best_sighting(boxes, ["video_id", "cls"]).columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_union_stores_narrow_boxes_and_postures(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(object_queries, "stored", lambda df, name, keep=object_queries.stored, **o: made.setdefault(name, keep(df, name, **o)))
    found = object_queries.q_findings_union(spark, SF)
    assert set(made) == {"grouped", "postures"} and "filled" not in made["grouped"].columns
    assert made["grouped"].agg({"box_id": "max"}).first()[0] < 1000
    handed = found.where("type = 'object_exchange'").select("video_id", "frame_idx", "track_id", "x1", "y1").collect()
    want = object_queries.q_exchange(spark, SF).select("video_id", "frame_idx", "track_id", "x1", "y1").collect()
    assert handed and sorted(handed) == sorted(want)
