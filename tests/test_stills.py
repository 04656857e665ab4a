"""Stills by their names, and baselines files that may be missing."""

import json

from eventide.operators import findings
from eventide.sources import readers


def test_the_snapshot_first_then_the_annotated_then_the_sampled_still(spark, tmp_path):
    for name in ["out/snapshots/event3_f0000012.jpg", "out/annotated/annotated_frame_0000012.jpg", "frames/a__f0000012__t0.5.jpg", "frames/a__f0000012__t0.4.jpg", "frames/a__f0000020__t1.jpg", "frames/b__f0000020__t1.jpg", "frames/notes.txt", "frames/a__f12__t1.jpg"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    stills = readers.listed_stills(spark, f"file://{tmp_path}")
    assert stills.count() == 6
    rows = [(1, 3, "a", 12, 20), (2, 4, "a", 12, 20), (3, 3, "a", 20, 20), (4, 3, "b", 0, 20), (5, 3, "b", None, 12), (6, 3, "c", 20, 20), (7, None, None, 99, None)]
    found = findings.with_stills(spark.createDataFrame(rows, "id int, event_id int, video string, frame_idx int, start_frame int"), stills)
    got = {r["id"]: r["still"] and r["still"].rsplit("/", 1)[1] for r in found.collect()}
    assert got == {1: "event3_f0000012.jpg", 2: "annotated_frame_0000012.jpg", 3: "a__f0000020__t1.jpg", 4: "b__f0000020__t1.jpg", 5: "annotated_frame_0000012.jpg", 6: None, 7: None}


def test_region_anomalies_of_a_file_that_may_be_missing(spark, tmp_path):
    def read(text):
        (tmp_path / "b.json").write_text(text)
        return sorted(tuple(r) for r in readers.region_anomalies(spark, f"file://{tmp_path}/b.json").collect())

    good = {"grid": [3, 4], "regions": {"r0c0": {"mu": 1}}, "anomalies": [{"frame_idx": 7, "region": "r0c1", "z": 4.5}, {"frame_idx": 7, "region": "r0c2", "z": 3.1}]}
    assert read(json.dumps(good, indent=1)) == [(7, "r0c1", 4.5), (7, "r0c2", 3.1)]
    assert read("{not json") == [] and read(json.dumps(good | {"grid": [3]})) == [] and read(json.dumps(good | {"grid": [0, 4]})) == []
    assert readers.region_anomalies(spark, f"file://{tmp_path}/none.json").count() == 0


def test_documents_over_several_lines(spark, tmp_path):
    (tmp_path / "profiles.json").write_text(json.dumps({"hall": {"a": 1}, "yard": {"a": 2}}, indent=2))
    (tmp_path / "job.json").write_text(json.dumps({"jobId": "j7"}, indent=2))
    assert sorted(tuple(r) for r in readers.keyed(spark, f"file://{tmp_path}/profiles.json", "a int").collect()) == [("hall", 1), ("yard", 2)]
    assert readers.active_job(spark, f"file://{tmp_path}/job.json", "none") == "j7"
