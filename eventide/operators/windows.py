"""Order-based building blocks: islands, interval joins and places in a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.storage import stored
from .scans import merged_intervals


def ordered(keys: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(starts: Column, window: WindowSpec) -> Column:
    """A number for each run of rows, which rises where ``starts`` is true."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(so_far(window))


def cover(first: Column, last: Column) -> Column:
    """The whole numbers from ``first`` to ``last`` as the fewest stretches of power-of-two length and place: (level, at) is at * 2^level and so many after it.

    Two stretches a level at most, and as many levels as the length has bits.
    """

    def parts(k: Column) -> Column:
        lo, hi = F.ceil(first / F.pow(F.lit(2.0), k)).cast("long"), F.floor((last + 1) / F.pow(F.lit(2.0), k)).cast("long")
        one = lambda use, at: F.when(use & (lo < hi), F.array(F.struct(k.cast("int").alias("level"), at.alias("at")))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))
        return F.concat(one(F.pmod(lo, F.lit(2)) == 1, lo), one(F.pmod(hi, F.lit(2)) == 1, hi - 1))

    bits = F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), bits), parts))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], point: str, start: str, end: str, tick: float, how: str = "inner") -> DataFrame:
    """Rows of ``left`` whose ``point`` lies in an interval of ``right``, ends included; ``how`` is inner or left_semi.

    Time is cut into ticks.  An interval costs at most two rows for each doubling of its length (``cover``), a point one for each
    length of stretch that occurs, and each pair meets once, in a hash join on the keys and a stretch; ``tick`` should be no longer than usual intervals.
    """
    if how == "left_semi":  # a point lies in one of the joined intervals at most
        whole = merged_intervals(right.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end")), keys, 0.0, "_start", "_end")
        return interval_join(left, whole.select(*keys, "_start", "_end"), keys, point, "_start", "_end", tick).select(*left.columns)
    tick_of = lambda c: F.floor(F.col(c) / tick).cast("long")
    r = right.where(F.col(start) <= F.col(end)).withColumn("_part", F.explode(cover(tick_of(start), tick_of(end))))
    r = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part.level").alias("_l"), F.col("_part.at").alias("_p"), *[c for c in r.columns if c not in (*keys, "_part")])
    # a single row of at most 64 levels
    levels = F.broadcast(r.agg(F.collect_set("_l").alias("_levels")))
    placed = left.crossJoin(levels).withColumn("_level", F.explode("_levels")).drop("_levels")
    placed = placed.withColumn("_at", F.floor(tick_of(point) / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    on = [placed[k] == r[f"_k{i}"] for i, k in enumerate(keys)] + [placed["_level"] == r["_l"], placed["_at"] == r["_p"], placed[point] >= r[start], placed[point] <= r[end]]
    return placed.join(r, on).drop("_level", "_at", "_l", "_p", *[f"_k{i}" for i in range(len(keys))])


def numbered_globally(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with each row's place from 1 in the order of the whole table, without gathering it in one task.

    Rows are dealt by ranges of the order and written once, numbered within each range; how many rows the ranges
    before hold is a sum over one row per range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    kept = stored(dealt, "numbered")
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as there are shuffle partitions
    starts = F.broadcast(sizes.select("_range", "_first", before.alias("_before")))
    return kept.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_range", "_at", "_first", "_before")


def latest(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(ordered(keys, *order))).where("_n = 1").drop("_n")
