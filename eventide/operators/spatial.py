"""Joins of boxes: plain where a key has few boxes, by a grid whose cells follow the boxes' own sizes where it has many.

A key with at most ``FEW`` boxes is joined on the key alone, which needs no rows but the boxes' own and leaves them where they lie.
In the grid each box lies on the level whose cells are four to eight times its longer side (a power of two), so it touches four cells there at most.  On the
levels of larger boxes it touches four at most too, and asks there; as many levels are asked as sizes occur, one for each doubling.
Two boxes are met in every cell that both touch; only the cell of their common corner counts, so each pair is met
once without a ``distinct``.  Work follows the pairs that lie near each other, not the square of a frame.

Boxes with a null edge meet nothing; boxes without extent are boxes like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

EDGES = ("x1", "y1", "x2", "y2")
#: The finest level: boxes without extent lie there.
FINEST = -20
#: Boxes that a key may have to be joined without the grid: each box meets so many at most.
FEW = 64
GROWN = ("_x1", "_y1", "_x2", "_y2", "_level")


def grown(df: DataFrame, prefix: str, reach: float | Column) -> DataFrame:
    """Adds the box that reaches out so far on each side, and the level of its size."""
    x1, y1, x2, y2 = (F.col(prefix + e).cast("double") for e in EDGES)
    out = F.lit(reach) if not isinstance(reach, Column) else reach
    df = df.withColumns({"_x1": x1 - out, "_y1": y1 - out, "_x2": x2 + out, "_y2": y2 + out}).where("_x1 + _y1 + _x2 + _y2 is not null and _x1 <= _x2 and _y1 <= _y2")
    side = F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"))
    return df.withColumn("_level", F.greatest(F.lit(FINEST), F.ceil(F.log2(F.greatest(side, F.lit(2.0**FINEST)))) + 2).cast("int"))


def in_cells(df: DataFrame) -> DataFrame:
    """A row for each cell of the level ``_at`` that the box touches."""
    size = F.pow(F.lit(2.0), F.col("_at"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return df.withColumn("_cx", span("_x1", "_x2")).withColumn("_cy", span("_y1", "_y2"))


def met(owners: DataFrame, askers: DataFrame, keys: list[str], levels: DataFrame) -> DataFrame:
    """Boxes of ``owners`` (on their own level) and of ``askers`` (of no larger level) that touch, each pair once."""
    own = in_cells(owners.withColumn("_at", F.col("_level")))
    # a single row: the levels that occur, one for each doubling of size
    asked = askers.crossJoin(F.broadcast(levels)).withColumn("_at", F.explode(F.filter("_levels", lambda x: x >= F.col("_level")))).drop("_levels")
    ask = in_cells(asked).withColumnsRenamed({c: f"_o{c}" for c in ("_x1", "_y1", "_x2", "_y2", "_level")})
    size = F.pow(F.lit(2.0), F.col("_at"))
    x, y = F.greatest("_x1", "_o_x1"), F.greatest("_y1", "_o_y1")
    both = own.join(ask, [*keys, "_at", "_cx", "_cy"])
    both = both.where((x <= F.least("_x2", "_o_x2")) & (y <= F.least("_y2", "_o_y2")) & (F.floor(x / size) == F.col("_cx")) & (F.floor(y / size) == F.col("_cy")))
    return both.drop("_at", "_cx", "_cy", *(f"{o}_{e}" for o in ("", "_o") for e in EDGES))


def levels_of(*tables: DataFrame) -> DataFrame:
    found = tables[0].select("_level")
    for t in tables[1:]:
        found = found.unionByName(t.select("_level"))
    return found.agg(F.collect_set("_level").alias("_levels"))


def crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that have over ``FEW`` rows."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return stored(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys), "crowded")


def met_plainly(a: DataFrame, b: DataFrame, keys: list[str], a_prefix: str, b_prefix: str, a_reach: float | Column, b_reach: float | Column) -> DataFrame:
    """Boxes of two tables with equal keys that touch once each is grown; no column is made that would have to be moved."""

    def bounds(prefix: str, reach: float | Column) -> tuple[Column, ...]:
        out = reach if isinstance(reach, Column) else F.lit(reach)
        x1, y1, x2, y2 = (F.col(prefix + e).cast("double") for e in EDGES)
        return x1 - out, y1 - out, x2 + out, y2 + out

    def sound(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return (x1 + y1 + x2 + y2).isNotNull() & (x1 <= x2) & (y1 <= y2)

    p, q = bounds(a_prefix, a_reach), bounds(b_prefix, b_reach)
    touch = (F.greatest(p[0], q[0]) <= F.least(p[2], q[2])) & (F.greatest(p[1], q[1]) <= F.least(p[3], q[3]))
    return a.where(sound(*p)).join(b.where(sound(*q)), keys).where(touch)


def box_pairs(boxes: DataFrame, keys: list[str], reach: float | Column = 0.0, box_id: str = "box_id") -> DataFrame:
    """Pairs of a table's boxes with equal keys that touch once each is grown by ``reach`` on every side: a_* and b_*, a_box_id the smaller."""
    parts = [box_id, *EDGES]
    side = lambda df, s: df.withColumnsRenamed({c: f"{s}_{c}" for c in (*parts, "_out") if c in df.columns})
    own = isinstance(reach, Column)
    reaches = (F.col("a__out"), F.col("b__out")) if own else (reach, reach)
    plainly = lambda df: met_plainly(side(df, "a"), side(df, "b"), keys, "a_", "b_", *reaches).where(F.col(f"a_{box_id}") < F.col(f"b_{box_id}")).select(*keys, *[f"{s}_{c}" for s in "ab" for c in parts])
    many = crowded(boxes, keys)
    plain = boxes.select(*keys, *parts, *([reach.alias("_out")] if own else []))
    if many.isEmpty():
        return plainly(plain)
    rows = stored(grown(plain, "", F.col("_out") if own else reach), "boxes")  # read as owners, as askers, for their levels and for the keys with few
    few, rows = rows.join(many, keys, "left_anti"), rows.join(many, keys, "left_semi")
    one, two = side(rows, "_p"), side(rows, "_q")
    first = F.col(f"_p_{box_id}") < F.col(f"_q_{box_id}")
    found = met(one, two, keys, levels_of(rows)).where((F.col(f"_p_{box_id}") != F.col(f"_q_{box_id}")) & ((F.col("_o_level") < F.col("_level")) | first))
    sides = [F.when(first, F.col(f"_{x}_{c}")).otherwise(F.col(f"_{y}_{c}")).alias(f"{side}_{c}") for side, x, y in (("a", "p", "q"), ("b", "q", "p")) for c in parts]
    return found.select(*keys, *sides).unionByName(plainly(few))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], left_prefix: str = "a_", right_prefix: str = "b_", reach: float | Column = 0.0) -> DataFrame:
    """Rows of two tables with equal keys whose boxes touch once each is grown by ``reach``; other columns go along and must not clash.

    The keys with few boxes in ``left`` are joined plainly, so a box of ``right`` meets ``FEW`` there at most.
    """
    many = crowded(left, keys)
    if many.isEmpty():
        return met_plainly(left, right, keys, left_prefix, right_prefix, reach, reach)
    a, b = stored(grown(left, left_prefix, reach), "boxes"), stored(grown(right, right_prefix, reach), "boxes")
    few = met_plainly(a.join(many, keys, "left_anti").drop(*GROWN), b.drop(*GROWN), keys, left_prefix, right_prefix, reach, reach)
    a, b = a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi")
    levels = levels_of(a, b)
    larger_left = met(a, b, keys, levels)
    larger_right = met(b, a, keys, levels).where("_o_level < _level")
    return larger_left.drop("_level", "_o_level").unionByName(larger_right.drop("_level", "_o_level")).unionByName(few)
