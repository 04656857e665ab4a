"""Crowds move by whole pixels, and objects change hands at wrists."""

import pytest

from eventide.operators import detectors, poses

JOINTS = ("nose", "ls", "rs", "lw", "rw", "lh", "rh")
POSE = "video_id int, track_id int, frame_idx int, t double, box_id int, " + ", ".join(f"{j}_{a} double" for j in JOINTS for a in "xyc")
OBJECT = "video_id int, frame_idx int, t double, cls string, conf double, object_id int, x1 int, y1 int, x2 int, y2 int"


@pytest.mark.parametrize(("to", "movers"), [((4, 13), 0), ((5, 13), 3)])
def test_crowd_centres_are_whole_pixels(spark, to, movers):
    """From x 0-10 to 4-13 the centre goes from 5 to 8: 3 pixels, 0.3 of the width, not the 0.35 of half pixels."""
    rows = []
    for track in range(3):
        for f in range(4):  # back and forth
            x1, x2 = (0, 10) if f % 2 == 0 else to
            rows.append((1, track, f, float(f), f, x1, 0, x2, 10))
    df = spark.createDataFrame(rows, "video_id int, track_id int, frame_idx int, t double, box_id int, x1 int, y1 int, x2 int, y2 int")
    found = detectors.crowd_runs(df, time="frame_idx", frames=1).collect()
    assert [r["peak"] for r in found] == ([movers] if movers else [])


def pose(track, x, wrist=None, conf=0.9, shoulder=0.9, wide=40.0, frame=5, box_id=1):
    at = {"nose": (x, 0.0, 0.9), "ls": (x, 100.0, shoulder), "rs": (x + wide, 100.0, 0.9), "lw": (*(wrist or (x - 500, 900)), conf), "rw": (x + 900.0, 900.0, 0.9), "lh": (x, 200.0, 0.9), "rh": (x, 200.0, 0.9)}
    return (1, track, frame, frame / 5, box_id, *(float(v) for j in JOINTS for v in at[j]))


PHONE = (1, 5, 1.0, "cell phone", 0.8, 1, 290, 290, 310, 310)


@pytest.mark.parametrize(
    ("second", "people"),
    [
        (pose(10, 400, (320, 300)), 2),
        (pose(10, 400, (336, 300)), 0),  # 0.9 of the shoulders away
        (pose(10, 400, (320, 300), conf=0.49), 0),
        (pose(10, 400, (320, 300), shoulder=0.3), 0),
        (pose(10, 400, (300, 300), wide=0.5), 0),
        (pose(9, 400, (320, 300)), 0),  # the same subject
        (pose(10, 400, (320, 300), frame=6), 0),
    ],
)
def test_a_handoff_needs_two_wrists(spark, second, people):
    rows = spark.createDataFrame([pose(9, 200, (281, 300)), second], POSE)
    found = detectors.exchanges(spark.createDataFrame([PHONE], OBJECT), poses.hands(rows, ["video_id"]), ["video_id"]).collect()
    assert [r["people"] for r in found] == ([people] if people else [])
    if people:
        assert (found[0]["track_id"], found[0]["other_id"]) == (10, 9)  # in order of their text


def test_either_wrist_and_only_the_first_pose_of_a_frame(spark):
    first, again = pose(9, 200, (900, 900), box_id=1), pose(9, 200, (300, 300), box_id=2)
    rows = spark.createDataFrame([first, again, pose(10, 400, (320, 300))], POSE)
    assert detectors.exchanges(spark.createDataFrame([PHONE], OBJECT), poses.hands(rows, ["video_id"]), ["video_id"]).count() == 0
    right = pose(9, -600, None)  # its right wrist is at x 300, y 900
    low = (1, 5, 1.0, "book", 0.8, 2, 290, 890, 310, 910)
    rows = spark.createDataFrame([right, pose(10, 400, (320, 900))], POSE)
    assert detectors.exchanges(spark.createDataFrame([low], OBJECT), poses.hands(rows, ["video_id"]), ["video_id"]).count() == 1
