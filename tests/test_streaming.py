"""Streaming twins give the batch results."""

from pyspark.sql import functions as F

from eventide.operators import tracks
from eventide.streaming import live


def stream_of(spark, df, path, parts):
    """A stream over files that hold the rows in order, one file a batch."""
    for i in range(parts):
        df.where(f"part = {i}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_live_events(spark, tmp_path):
    data = [(v, float(t), 0.9 if (t + v) % 10 < 4 else 0.0, t // 20) for v in range(3) for t in range(60)]
    df = spark.createDataFrame(data, "video_id int, t double, s_final double, part int")
    got = live.run_available(live.live_events(stream_of(spark, df, str(tmp_path / "in"), 3), 0.5, 0.2), "events", f"file://{tmp_path}")
    want = set()
    for v in range(3):
        start = None
        for t in range(60):
            s = 0.9 if (t + v) % 10 < 4 else 0.0
            if start is None and s >= 0.5:
                start = t
            elif start is not None and s < 0.2:
                want.add((v, float(start), float(t)))
                start = None
    assert {(r["video_id"], r["start"], r["end"]) for r in got.collect()} == want


def test_live_tracks(spark, tmp_path):
    data = [(1, f, b, 100 * b + f, 0, 100 * b + f + 50, 50, f // 5) for f in range(15) for b in range(3)]
    df = spark.createDataFrame(data, "video_id int, frame_idx int, box_id int, x1 int, y1 int, x2 int, y2 int, part int")
    got = live.run_available(live.live_tracks(stream_of(spark, df, str(tmp_path / "in"), 3)), "tracks", f"file://{tmp_path}")
    want = tracks.tracked(df)
    key = lambda d: sorted((r["frame_idx"], r["box_id"], r["track"]) for r in d.collect())
    assert key(got) == key(want)


def test_live_counts(spark, tmp_path):
    e = spark.range(200).select((F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = live.run_available(live.live_counts(s), "counts", f"file://{tmp_path}")
    assert {r["events"] for r in got.collect()} == {60}
