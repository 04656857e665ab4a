"""Streaming twins of the latch, the tracker and the tile counts.

The batch operators define the results; these keep the state of each video between
micro-batches.  Frames of a video must arrive in order of time, but for rows within a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import Tracker


def live_events(frames: DataFrame, hi: float, lo: float, column: str = "s_final") -> DataFrame:
    """(video_id, start, end, late): hysteresis events as they close; the end is the first frame below ``lo``.

    Frames are told apart by time and, if there is one, ``frame_idx``.  A frame that is before the last one of an earlier batch can't change
    what was decided; a row without start and end says how many of these a batch had.
    """
    numbered = "frame_idx" in frames.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, *seen = state.get if state.exists else (None, float("-inf"), -1)
        rows, late = [], 0
        frame = pd.concat(list(batches))
        frame["_n"] = frame["frame_idx"] if numbered else 0
        for t, n, s in frame.sort_values(["t", "_n"])[["t", "_n", column]].itertuples(index=False, name=None):
            if (t, n) < tuple(seen):
                late += 1
                continue
            if start is None and s >= hi:
                start = t
            elif start is not None and s < lo:
                rows.append((key[0], start, t, 0))
                start = None
            seen = t, n
        state.update((start, float(seen[0]), int(seen[1])))
        rows += [(key[0], None, None, late)] * (late > 0)
        yield pd.DataFrame(rows, columns=["video_id", "start", "end", "late"])

    kind = frames.schema["video_id"].dataType.simpleString()
    return frames.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, start double, end double, late bigint", "start double, seen double, number bigint", "append", GroupStateTimeout.NoTimeout)


def live_tracks(detections: DataFrame) -> DataFrame:
    """(video_id, frame_idx, box_id, track): the tracker, with its tracks as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, step = Tracker(), 0
        if state.exists:
            saved = json.loads(state.get[0])
            tracker.boxes, tracker.state = np.array(saved["boxes"], float).reshape(-1, 4), np.array(saved["state"], np.int64).reshape(-1, 3)
            tracker.made, step = saved["made"], saved["step"]
        rows = []
        for frame_idx, group in pd.concat(list(batches)).sort_values(["frame_idx", "box_id"]).groupby("frame_idx", sort=True):
            ids = group["box_id"].tolist()
            rows += [(key[0], frame_idx, ids[i], f"Track-{n:02d}") for i, n in tracker.update(group[["x1", "y1", "x2", "y2"]].to_numpy(float), step)]
            step += 1
        state.update((json.dumps({"boxes": tracker.boxes.tolist(), "state": tracker.state.tolist(), "made": tracker.made, "step": step}),))
        yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "box_id", "track"])

    kind = {f.name: f.dataType.simpleString() for f in detections.schema}
    return detections.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind['video_id']}, frame_idx {kind['frame_idx']}, box_id {kind['box_id']}, track string", "saved string", "append", GroupStateTimeout.NoTimeout)


def live_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(from_ts, event_type, events, total): counts of event-time windows, each given once when no late row can change it.

    An extension: batch inputs have no late rows.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("from_ts"), "event_type", "events", "total")


def serve(stream: DataFrame, take: Callable[[DataFrame, int], None], state: str) -> None:
    """Hands ``take`` the batches of what is new since the last run; ``state`` is the folder that remembers how far it came."""
    stream.writeStream.option("checkpointLocation", state).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it has written."""
    spark = stream.sparkSession
    out = f"{checkpoint}/{name}-out"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}-state").option("path", out).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
