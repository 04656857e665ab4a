"""Versioned tables: two writers, replayed batches, readers of old versions; and rows that come late in a stream."""

import threading

import pytest
from pyspark.sql import functions as F

from eventide.operators import ledger
from eventide.sources import sinks
from eventide.sources.versions import Lost, VersionedTable
from eventide.streaming import live

STATEMENTS = "job_id int, seq int, statement_hash string"


def test_versions_and_vacuum(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.read() is None
    assert t.append(spark.range(3).toDF("k")) == 1
    assert t.append(spark.range(10, 12).toDF("k")) == 2
    assert t.replace(spark.range(5, 6).toDF("k")) == 3
    held = lambda v: sorted(r["k"] for r in t.read(v).collect())
    assert held(1) == [0, 1, 2] and held(2) == [0, 1, 2, 10, 11] and held(None) == [5]
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("x",)], "k string"))
    assert t.vacuum() >= 2 and held(None) == [5] and t.replace(t.read().where("false")) == 4 and held(None) == []


def test_two_writers_leave_no_gap_and_no_doubles(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    VersionedTable(spark, path).append(ledger.chained(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], STATEMENTS)))
    errors = []

    def write(who):
        try:
            log = VersionedTable(spark, path)
            for k in range(3):
                sinks.append_entries(log, spark.createDataFrame([(1, 1, f"{who}{k}"), (2, 1, f"{who}{k}")], STATEMENTS))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    log = VersionedTable(spark, path).read()
    assert VersionedTable(spark, path).version() == 7
    assert sorted((r["job_id"], r["seq"]) for r in log.collect()) == [(1, k) for k in range(1, 9)] + [(2, k) for k in range(1, 7)]
    assert {r["statement_hash"] for r in log.where("job_id = 2").collect()} == {f"{w}{k}" for w in "xy" for k in range(3)}
    assert ledger.problems(log).count() == 0


def test_a_writer_that_always_loses_says_so(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.range(1).toDF("k")

    def build(_):
        VersionedTable(spark, t.path).append(rows)
        return rows

    with pytest.raises(Lost):
        t.update(build, "append", tries=2)
    assert t.version() == 2 and t.read().count() == 2


def test_a_replayed_batch_changes_nothing_and_a_second_run_reads_only_new_files(spark, tmp_path):
    counts = VersionedTable(spark, f"file://{tmp_path}/counts")
    take = sinks.counted_once(counts, "jobs", ["k"])
    seen = []

    def counted(batch, number):
        seen.append(batch.count())
        take(batch, number)

    def run():
        live.serve(spark.readStream.schema("k long").parquet(f"{tmp_path}/in"), counted, f"file://{tmp_path}/state")
        return sorted((r["k"], r["n"]) for r in counts.read().collect())

    spark.range(6).select(F.col("id") % 2).toDF("k").write.parquet(f"{tmp_path}/in")
    assert run() == [(0, 3), (1, 3)]
    spark.range(4).select(F.col("id") % 4).toDF("k").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [(0, 4), (1, 4), (2, 1), (3, 1)] and seen == [6, 4]
    take(spark.range(100).select(F.lit(0).cast("long").alias("k")), 1)  # the last batch once more
    assert run() == [(0, 4), (1, 4), (2, 1), (3, 1)] and counts.version() == 2


def test_pruning_in_place(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(6).toDF("k").write.parquet(path)
    rows, taken = spark.read.parquet(path), []
    sinks.pruned(rows, path, rows.where("k > 3"), ["k"], lambda gone: taken.extend(r["k"] for r in gone.collect()))
    assert sorted(taken) == [4, 5] and sorted(r["k"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_late_rows_are_counted(spark, tmp_path):
    rows = [[(1, 0.0, 0, 0.9), (1, 5.0, 1, 0.9)], [(1, 4.0, 7, 0.0), (1, 5.0, 0, 0.0), (1, 5.0, 2, 0.0), (1, 6.0, 3, 0.9)], [(1, 9.0, 4, 0.0)]]
    schema = "video_id int, t double, frame_idx int, s_final double"
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = live.run_available(live.live_events(stream, 0.5, 0.2), "events", f"file://{tmp_path}")
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, 0.0, 5.0, 0), (1, 6.0, 9.0, 0), (1, None, None, 2)]


def test_scratch_deletes_what_is_stored(spark):
    from eventide.sources.storage import scratch, stored

    kept = stored(spark.range(3), "kept")
    with scratch(spark):
        table = stored(spark.range(5), "table")
        total = table.count()
    assert total == 5 and kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|no such file|does not exist"):
        table.count()
