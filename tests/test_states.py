"""Streams with rows out of order give what the batch operators give; late rows are counted, quiet keys expire."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import detectors, ledger
from eventide.streaming import states


@pytest.fixture(autouse=True)
def rocksdb(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def streamed(spark, batches, schema, tmp_path, keys, fold, time, **rules):
    """(rows, late rows) of a fold over batches, each a file."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = states.in_order(stream, keys, fold, time, **rules)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()], states.late_rows(query)


def test_loitering_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    schema = "video_id bigint, track_id bigint, t double, frame_idx bigint, box_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, conf double"
    rows = []
    for track in range(3):
        x = 100
        for k in range(120):
            x += rng.choice([0, 0, 0, 0, 0, 40])
            rows.append((1, track, 1000.0 + k * 10, k, k, x, 50, x + 30, 90, 0.5))
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 60))  # up to a minute out of order
    batches = [shuffled[i : i + 60] for i in range(0, len(shuffled), 60)] + [[(2, 9, 1e6, 0, 0, 0, 0, 1, 1, 0.5)]]  # its time lets all before go by
    found, late = streamed(spark, batches, schema, tmp_path, ["video_id", "track_id"], states.Loitering(100.0), "t", late="10 minutes")
    want = detectors.stationary(spark.createDataFrame(rows, schema), 100.0).select("video_id", "track_id", "start", "end", "frame_idx", "x1", "y1", "x2", "y2", "duration")
    assert late == 0
    assert sorted(found) == sorted(tuple(r) for r in want.collect())
    assert len(found) > 5


def test_holds_late_rows_and_expiry(spark, tmp_path):
    schema = "video_id bigint, t double, frame_idx bigint"
    batches = [[(1, 1000.0, 0), (1, 1003.0, 2)], [(1, 1001.0, 1)], [(2, 1100.0, 0)], [(2, 1100.5, 1)], [(1, 1002.0, 9)], [(3, 5000.0, 0)]]
    found, late = streamed(spark, batches, schema, tmp_path, ["video_id"], states.Holds(0.5), "t", late="10 seconds", quiet_seconds=50.0)
    # video 1 is over when 1053 has passed; the row at 1002 comes after the watermark was at 1090
    assert sorted(found) == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 0.5), (2, 0, 0.5), (2, 1, 0.5)] and late == 1


def test_job_states(spark, tmp_path):
    moves = list(ledger.TRANSITIONS)
    schema = "job_id bigint, ts double, n bigint, message string"
    rng = random.Random(3)
    rows = [(j, 1000.0 + k, k, rng.choice(moves)[1]) for j in range(4) for k in range(30)]
    batches = [sorted(rows[i::3], key=lambda _: rng.random()) for i in range(3)] + [[(99, 1e5, 0, "x")]]
    found, _ = streamed(spark, batches, schema, tmp_path, ["job_id"], states.JobStates(), "ts", late="1 hour")
    last = {}
    for j, n, state, taken in sorted(x for x in found if x[0] != 99):
        accepted = last.get(j, ("", 0, 0))
        last[j] = (state or "", accepted[1] + taken, accepted[2] + (not taken))
    batch = ledger.job_states(spark.createDataFrame(rows, "job_id bigint, ts double, n bigint, message string"))
    assert {r["job_id"]: (r["state"], r["accepted"], r["refused"]) for r in batch.collect()} == last


def test_chain_problems(spark, tmp_path):
    good = ledger.chained(spark.createDataFrame([(j, k, f"s{j}{k}") for j in (1, 2) for k in range(1, 9)], "job_id int, seq int, statement_hash string"))
    log = good.where("not (job_id = 1 and seq = 4)").withColumn("statement_hash", F.when(F.expr("job_id = 2 and seq = 6"), "other").otherwise(F.col("statement_hash")))
    schema = "job_id int, seq int, statement_hash string, prev_hash string, entry_hash string, at double"
    rows = [(r["job_id"], r["seq"], r["statement_hash"], r["prev_hash"], r["entry_hash"], 1000.0 + r["seq"]) for r in log.collect()]
    batches = [rows[1::2], rows[::2], [(9, 1, "x", ledger.GENESIS, "y", 1e5)]]
    found, _ = streamed(spark, batches, schema, tmp_path, ["job_id"], states.ChainProblems(), "at", late="1 hour")
    assert sorted(x for x in found if x[0] != 9) == sorted(tuple(r) for r in ledger.problems(log).collect())
