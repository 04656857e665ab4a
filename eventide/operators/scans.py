"""Running values over long series: one key's rows may fill all tasks.

A plain window takes a whole key through one task.  Here rows are dealt by ranges of (keys, order), so a key's rows lie in as many
stretches as its share of the table asks for.  Each stretch is summed up in a row; a scan over these few rows gives what each stretch
takes over from those before it; and within a stretch an ordinary window goes on from there.  That works for all that can be composed of
parts: last value, least, largest, sum, the last few rows, the next row.

``series`` deals the rows out, ``scanned`` adds any number of running columns in one pass.  Order columns should tell all rows of a key
apart, as in any window.  Null keys are a key like any other; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

CHUNK = "_stretch"


@dataclass(frozen=True)
class Series:
    """Rows in stretches: no two stretches of a key overlap in its order."""

    rows: DataFrame
    keys: list[str]
    order: list[str]

    @property
    def place(self) -> Column:
        return F.struct(*self.order)

    def frame(self) -> DataFrame:
        return self.rows.drop(CHUNK)

    def where(self, condition: Column | str) -> Series:
        return Series(self.rows.where(condition), self.keys, self.order)

    def select(self, *columns: str | Column) -> Series:
        """Chosen columns; keys, order and stretch stay."""
        named = [c for c in columns if isinstance(c, str)]
        kept = [c for c in (*self.keys, *self.order) if c not in named]
        return Series(self.rows.select(*kept, *columns, CHUNK), self.keys, self.order)

    def with_columns(self, **columns: Column) -> Series:
        return Series(self.rows.withColumns(columns), self.keys, self.order)


def series(df: DataFrame, keys: list[str], order: list[str], stretches: int | None = None) -> Series:
    """``df`` dealt by ranges of keys and order, and written once: ranges found again could be others."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = df.repartitionByRange(stretches, *by) if stretches else df.repartitionByRange(*by)
    return Series(stored(dealt.withColumn(CHUNK, F.spark_partition_id()), "series"), keys, order)


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column
    before: bool = False
    rows: int = 0


def last(value: Column, before: bool = False) -> Scan:
    """The last value that isn't null up to this row, or ``before`` it."""
    return Scan("last", value, before)


def least(value: Column, before: bool = False, rows: int = 0) -> Scan:
    """The least value so far, or of the last ``rows`` rows with this one."""
    return Scan("least", value, before, rows)


def largest(value: Column, before: bool = False, rows: int = 0) -> Scan:
    return Scan("largest", value, before, rows)


def total(value: Column, before: bool = False) -> Scan:
    """The sum so far; exact for whole numbers, while fractions are added in another order than row by row."""
    return Scan("total", value, before)


def number() -> Scan:
    """The row's place in its key, from 1."""
    return Scan("total", F.lit(1).cast("long"))


def ago(value: Column, rows: int) -> Scan:
    """The value so many rows ago, null in the first rows."""
    return Scan("ago", value, rows=rows)


def following(value: Column) -> Scan:
    """The next row's value, null in the last row."""
    return Scan("following", value)


def overall(value: Column) -> Scan:
    """The largest value of the whole key."""
    return Scan("overall", value)


def scanned(s: Series, **scans: Scan) -> Series:
    """``s`` with a column for each scan."""
    at = {name: f"_in_{name}" for name in scans}
    rows = s.rows.withColumns({at[n]: x.value for n, x in scans.items()})
    summary, few = [], max((x.rows - (x.kind != "ago") for x in scans.values()), default=0)
    for name, x in scans.items():
        v = F.col(at[name])
        if x.kind == "last":
            summary.append(F.max_by(v, F.when(v.isNotNull(), s.place)).alias(at[name]))
        elif x.kind == "following":
            summary.append(F.min_by(F.struct(v.alias("v")), s.place).alias(at[name]))
        elif not x.rows:
            summary.append({"least": F.min, "largest": F.max, "overall": F.max, "total": F.sum}[x.kind](v).alias(at[name]))
    parts = rows.groupBy(*s.keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"), *summary)
    tails = [n for n, x in scans.items() if x.rows]
    if tails:
        # the last few rows of each stretch
        back = Window.partitionBy(*s.keys, CHUNK).orderBy(*[F.col(c).desc_nulls_last() for c in s.order])
        ends = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= few)
        tail = F.reverse(F.array_sort(F.collect_list(F.struct("_back", *[F.col(at[n]) for n in tails]))))
        ends = ends.groupBy(*s.keys, CHUNK).agg(tail.alias("_tail"))
        parts = null_safe_join(parts, ends, [*s.keys, CHUNK])

    across = Window.partitionBy(*s.keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, x in scans.items():
        v = F.col(at[name])
        if x.rows:
            continue
        over = {
            "last": lambda v: F.last(v, ignorenulls=True).over(earlier), "least": lambda v: F.min(v).over(earlier), "largest": lambda v: F.max(v).over(earlier), "total": lambda v: F.sum(v).over(earlier),
            "following": lambda v: F.lead(v).over(across), "overall": lambda v: F.max(v).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }[x.kind]
        carried.append(over(v).alias(f"_carry_{name}"))
    if tails:
        # each stretch has a row at least, so so many stretches hold so many rows
        carried.append(F.flatten(F.collect_list("_tail").over(across.rowsBetween(-few, -1))).alias("_carry_tail"))
    carry = parts.select(*s.keys, CHUNK, *carried)

    inner = Window.partitionBy(*s.keys, CHUNK).orderBy(*[F.col(c).asc_nulls_first() for c in s.order])
    upto, sofar = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_nth", F.row_number().over(inner)) if tails else rows
    rows = rows.withColumns({f"_here_{n}": within(x, F.col(at[n]), inner, upto if x.before else sofar) for n, x in scans.items() if x.kind != "overall"})
    rows = null_safe_join(rows, carry, [*s.keys, CHUNK])
    found = {n: composed(n, x, at[n]) for n, x in scans.items()}
    return Series(rows.select(*[c for c in s.rows.columns if c not in found], *[v.alias(n) for n, v in found.items()]), s.keys, s.order)


def within(x: Scan, v: Column, inner, frame) -> Column:  # noqa: ANN001
    """The scan over the rows of the stretch alone."""
    if x.kind == "last":
        return F.last(v, ignorenulls=True).over(frame)
    if x.kind == "ago":
        return F.lag(v, x.rows).over(inner)
    if x.kind == "following":
        return F.lead(F.struct(v.alias("v"))).over(inner)
    frame = inner.rowsBetween(1 - x.rows, Window.currentRow) if x.rows else frame
    return {"least": F.min, "largest": F.max, "total": F.sum}[x.kind](v).over(frame)


def composed(name: str, x: Scan, at: str) -> Column:
    """What the stretch has by itself together with what it takes over."""
    here, carry, tail = F.col(f"_here_{name}"), F.col(f"_carry_{name}"), F.col("_carry_tail")
    if x.kind == "overall":
        return carry
    if x.kind == "following":
        return F.coalesce(here, carry)["v"]
    if x.kind == "ago":
        missing = F.lit(x.rows + 1) - F.col("_nth")  # so many rows from the end of those before
        earlier = F.when(F.size(tail) >= missing, F.element_at(tail, (-missing).cast("int"))[at])
        return F.when(F.col("_nth") > x.rows, here).otherwise(earlier)
    if x.rows:
        missing = F.lit(x.rows) - F.col("_nth")
        earlier = F.transform(F.slice(tail, F.greatest(F.lit(1), F.size(tail) - missing + 1), F.greatest(F.lit(0), missing)), lambda r: r[at])
        return F.least(here, F.array_min(earlier)) if x.kind == "least" else F.greatest(here, F.array_max(earlier))
    if x.kind == "last":
        return F.coalesce(here, carry)
    if x.kind == "total":
        return F.coalesce(here + carry, here, carry)
    return F.least(here, carry) if x.kind == "least" else F.greatest(here, carry)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def merged_intervals(df: DataFrame, keys: list[str], gap: float, start: str = "start", end: str = "end", aggs: list[Column] | None = None) -> DataFrame:
    """Intervals joined where one starts within ``gap`` of the furthest end before it; ``_nth`` numbers a key's joined intervals."""
    s = scanned(series(df, keys, [start, end]), _reach=largest(F.col(end), before=True))
    s = scanned(s.with_columns(_new=(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap)).cast("long")), _nth=total(F.col("_new")))
    return s.rows.groupBy(*keys, "_nth").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged"), *(aggs or []))


def latched(s: Series, value: Column, hi: float, lo: float, name: str = "on") -> Series:
    """1 from the first value of at least ``hi`` to the first below ``lo``, else 0: the last value outside the band decides."""
    if hi < lo:
        raise ValueError("hi must not be below lo")
    edge = F.when(value >= hi, 1).when(value < lo, 0)
    s = scanned(s, **{name: last(edge)})
    return s.with_columns(**{name: F.coalesce(name, F.lit(0))})
