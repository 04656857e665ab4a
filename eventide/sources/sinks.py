"""Writers: tables, nested documents, upserts and verdict logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import latest
from .storage import drop_stored, stored
from .versions import VersionedTable


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header; structs become columns with their name in front."""
    df = flattened(df)
    df.write.mode("overwrite").option("header", True).csv(path)


def flattened(df: DataFrame, shorten: dict[str, str] | None = None) -> DataFrame:
    """Struct columns spread out as ``<column>_<field>``; arrays as text."""
    shorten = {"roi_summary": "roi"} | (shorten or {})
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "struct":
            out += [F.col(f"{f.name}.{x.name}").alias(f"{shorten.get(f.name, f.name)}_{x.name}") for x in f.dataType]
        else:
            out.append(F.to_json(f.name).alias(f.name) if kind in ("array", "map") else F.col(f.name))
    return df.select(*out)


def nested_by_frame(rois: DataFrame, columns: list[str]) -> DataFrame:
    """One row per frame with its regions as an array, in order of their number."""
    return rois.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rois"))


def replaced(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions of ``by`` that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys in ``gone``."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def touched(old: DataFrame, new: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """``upserted`` with ``updated_at``: rows that changed get ``at``, others keep their own."""
    values = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*values).alias("_was"), F.col("updated_at").alias("_at"))
    same = F.col("_was").eqNullSafe(F.struct(*values))
    fresh = new.join(before, keys, "left").withColumn("updated_at", F.when(F.col("_at").isNotNull() & same, F.col("_at")).otherwise(at)).drop("_was", "_at")
    return upserted(old, fresh.select(*old.columns), keys)


def pruned(rows: DataFrame, path: str, gone: DataFrame, keys: list[str], record: Callable[[DataFrame], None]) -> None:
    """Writes ``rows`` without the keys in ``gone`` to ``path``, after ``record`` has taken them down.

    If they cannot be recorded, its error ends the call and nothing is removed.  ``rows`` may come from ``path`` itself:
    what stays is written aside before anything is recorded.
    """
    kept = stored(without(rows, gone, keys), "pruned")
    record(gone.select(*keys).distinct())
    kept.write.mode("overwrite").parquet(path)
    drop_stored(kept)


def append_entries(log: VersionedTable, statements: DataFrame) -> DataFrame:
    """Appends the links of new statements after the head of each log; of two writers the later links after the earlier.

    Returns the log with its new entries.  No number is given twice and none is left out, since a writer that comes late builds its links again.
    """
    from ..operators.ledger import appended

    empty = "job_id int, seq int, statement_hash string, prev_hash string, entry_hash string"
    version = log.update(lambda old: appended(old if old is not None else log.spark.createDataFrame([], empty), statements), "append")
    return log.read(version)


def counted_once(table: VersionedTable, name: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds a batch's row counts by key to a served table, each batch once.

    A batch that is replayed after a crash has its number in the last manifest, and changes nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        fold = lambda old: new if old is None else old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))
        table.update(fold, "replace", taken={name: number})

    return take


def reattached(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of an earlier run carried to the findings of a new one by job, type and frame."""
    newest = latest(verdicts, ["job_id", "type", "frame_idx"], F.desc("ts"))
    return findings.join(newest.select("job_id", "type", "frame_idx", "verdict"), ["job_id", "type", "frame_idx"], "left")


def heat_grid(boxes: DataFrame, cell: int = 20) -> DataFrame:
    """How often each cell of a grid is covered, as a share of the busiest; a picture's data, not the picture."""
    xs = F.sequence(F.floor(F.col("x1") / cell), F.floor((F.col("x2") - 1) / cell))
    ys = F.sequence(F.floor(F.col("y1") / cell), F.floor((F.col("y2") - 1) / cell))
    cells = boxes.where("x2 > x1 and y2 > y1").select("video_id", F.explode(xs).alias("cx"), "y1", "y2").select("video_id", "cx", F.explode(ys).alias("cy"))
    heat = cells.groupBy("video_id", "cx", "cy").agg(F.count(F.lit(1)).alias("hits"))
    most = heat.groupBy("video_id").agg(F.max("hits").alias("most"))
    return heat.join(most, "video_id").select("video_id", "cx", "cy", "hits", (F.col("hits") / F.col("most")).alias("heat"))


def stage_progress(stages: DataFrame) -> DataFrame:
    """Cumulative share of finished work at each stage of a job, in percent."""
    w = Window.partitionBy("job_id").orderBy("stage")
    total = Window.partitionBy("job_id")
    return stages.withColumn("percent", F.round(100 * F.sum("weight").over(w) / F.sum("weight").over(total), 1))
