"""The tracker over many frames at a time gives what it gives frame by frame, at a fraction of the time."""

import random
import time
from itertools import pairwise

import numpy as np

from eventide.operators import tracks

SCHEMA = "video_id int, frame_idx int, box_id int, x1 int, y1 int, x2 int, y2 int"


def detections(seed, videos, frames, span):
    """Rows in order: some frames are missing, some boxes are turned round or empty."""
    rng = random.Random(seed)
    found = []
    for v in range(videos):
        for f in sorted(rng.sample(range(frames * 2), frames)):
            for k in range(rng.randrange(1, 6)):
                x, y = rng.randrange(span), rng.randrange(span)
                found.append((v, f, f * 10 + k, x, y, x + rng.randrange(-1, 40), y + rng.randrange(40)))
    return found


def frame_by_frame(rows):
    frames: dict = {}
    for r in rows:
        frames.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    out = []
    for v, of in frames.items():
        tracker = tracks.Tracker()
        for step, (f, boxes) in enumerate(of.items()):
            out += [(v, f, boxes[j][2], f"Track-{n:02d}") for j, n in tracker.update(np.array([b[3:] for b in boxes], float), step)]
    return out


def test_pieces_and_videos():
    for seed in range(20):
        rows = detections(seed, 3, 80, (40, 90, 400)[seed % 3])
        frame, video = (np.array([i == 0 or r[:k] != rows[i - 1][:k] for i, r in enumerate(rows)]) for k in (2, 1))
        rng, trackers, got = random.Random(seed), tracks.Trackers(), []
        for a, b in pairwise([i for i in np.flatnonzero(frame).tolist() if i == 0 or rng.random() < 0.2] + [len(rows)]):
            at, numbers = trackers.update(np.array([r[3:] for r in rows[a:b]], float), frame[a:b], video[a:b])
            got += [(*rows[a + i][:3], f"Track-{n:02d}") for i, n in zip(at.tolist(), numbers.tolist(), strict=True)]
        assert sorted(got) == sorted(frame_by_frame(rows)) and got


def test_frames_over_batches_and_nulls(spark):
    rows = detections(5, 3, 60, 60)
    odd = [(None, *r[1:]) if r[0] == 2 else (r[0], None, *r[2:]) if r[:2] == rows[0][:2] else r for r in rows]
    want = frame_by_frame(odd)
    df = spark.createDataFrame([*odd, (0, 7, None, 0, 0, 9, 9), (9, 1, None, 0, 0, 9, 9)], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = [tuple(r) for r in tracks.tracked(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[0] is None for r in got)
    assert tracks.tracked(df.where("false")).count() == 0


def test_frames_take_a_fraction_of_the_time():
    rows = detections(1, 1, 8000, 300)
    began = time.process_time()
    frame_by_frame(rows)
    one_by_one = time.process_time() - began
    boxes, frame = np.array([r[3:] for r in rows], float), np.array([i == 0 or r[1] != rows[i - 1][1] for i, r in enumerate(rows)])
    began = time.process_time()
    tracks.Trackers().update(boxes, frame, np.arange(len(rows)) == 0)
    assert time.process_time() - began < one_by_one / 3
