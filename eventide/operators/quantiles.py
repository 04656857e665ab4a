"""Exact percentiles with linear interpolation, whatever the size of a group.

Spark's ``percentile`` keeps all distinct values of a group in one task.  That is fine for groups of up to ``HELD`` rows.  A larger group is
searched instead: its values are counted in ``BINS`` equal bins between its least and largest value, a partial aggregation that
leaves a row per bin; only the bins that hold the wanted ranks are looked at again, in the same way between their own least and
largest value, until a bin has ``HELD`` rows or a single value.  No task ever holds a group.

Null and NaN values don't count; values must be finite; a group without values has null percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .scans import null_safe_join
from .skew import BROADCAST_ROWS

HELD, BINS = 100_000, 1024
#: Every other round bins by magnitude, so two rounds part any two decades; then each narrows a thousandfold, and doubles have 53 bits.
ROUNDS = 40


def number(c: str | Column) -> Column:
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str | Column, float]], held: int | None = None) -> DataFrame:
    """A row per key with a column for each (value, share) of ``wanted``."""
    held = HELD if held is None else held
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held).select(*keys)
    plain = lambda rows: rows.groupBy(*keys).agg(*[F.percentile(number(c), p).alias(name) for name, (c, p) in wanted.items()])
    large = stored(large, "large-groups")  # as many as groups of over ``held`` rows fit in the table
    if large.isEmpty():
        return plain(df)
    mark = large.withColumn("_large", F.lit(True)).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    marked = df.join(mark, [df[k].eqNullSafe(mark[f"_r_{k}"]) for k in keys], "left").drop(*[f"_r_{k}" for k in keys])
    columns = [(number(c), p) for c, p in wanted.values()]
    rows = marked.where("_large").select(*keys, F.posexplode(F.array(*[v for v, _ in columns])).alias("_c", "_v"))
    found = searched(stored(rows.where("_v is not null"), "percentile-values"), keys, [p for _, p in columns], held)
    of = lambda i: F.max(F.when(F.col("_c") == i, F.col("_value")))
    wide = found.groupBy(*keys).agg(*[of(i).alias(name) for i, name in enumerate(wanted)])
    empty = null_safe_left(large, wide, keys)
    return plain(marked.where("_large is null")).unionByName(empty)


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys], "left").drop(*[f"_r_{k}" for k in keys])


def magnitude(v: Column) -> Column:
    """Rises with ``v``, evenly by decades on both sides of 0."""
    return F.signum(v) * F.coalesce(F.ln(F.abs(v)) + 746, F.lit(0.0))


def searched(values: DataFrame, keys: list[str], shares: list[float], held: int) -> DataFrame:
    """(keys, _c, _value): the percentile of column ``_c`` at its share, by narrowing the bins that hold the ranks."""
    group = [*keys, "_c"]
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("_c") + 1)
    whole = values.groupBy(*group).agg(F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = whole.withColumn("_at", (F.col("_inside") - 1) * share)
    ranks = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))
    brackets = stored(whole.select(*group, "_at", ranks.alias("_rank"), F.lit(0).cast("long").alias("_below"), "_inside", "_lo", "_hi"), "percentile-brackets")
    wide = (F.col("_inside") > held) & (F.col("_lo") < F.col("_hi"))
    for k in range(ROUNDS):
        if brackets.where(wide).isEmpty():
            break
        open_ = brackets.where(wide)
        spans = open_.select(*group, "_lo", "_hi").distinct()
        v, lo, hi = (magnitude(F.col(c)) if k % 2 else F.col(c) / 2 for c in ("_v", "_lo", "_hi"))  # halves, as the difference may be past the largest double
        share = F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))
        inside = met(values, spans, group).withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(share * BINS)))
        bins = inside.groupBy(*group, "_lo", "_bin").agg(F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.coalesce(F.sum("_count").over(Window.partitionBy(*group, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrowed = null_safe_join(open_, bins.withColumn("_before", before), [*group, "_lo"])
        start = F.col("_below") + F.col("_before")
        narrowed = narrowed.where((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_count")))
        narrowed = narrowed.select(*group, "_at", "_rank", start.alias("_below"), F.col("_count").alias("_inside"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"))
        brackets = stored(narrowed.unionByName(brackets.where(~wide)), "percentile-brackets")
    else:
        raise RuntimeError("percentile bins did not narrow")
    one = F.col("_lo") == F.col("_hi")
    last = brackets.where(~one)
    # a bracket has ``held`` rows at most
    place = F.row_number().over(Window.partitionBy(*group, "_lo").orderBy("_v")) - 1
    sorted_ = met(values, last.select(*group, "_lo", "_hi").distinct(), group).withColumn("_place", place).select(*group, "_lo", "_place", "_v")
    picked = null_safe_join(last, sorted_, [*group, "_lo"]).where("_rank = _below + _place")
    ends = picked.select(*group, "_at", "_rank", "_v").unionByName(brackets.where(one).select(*group, "_at", "_rank", F.col("_lo").alias("_v")))
    both = ends.groupBy(*group).agg(F.first("_at").alias("_at"), F.min("_rank").alias("_k0"), F.max("_rank").alias("_k1"), F.min_by("_v", "_rank").alias("_v0"), F.max_by("_v", "_rank").alias("_v1"))
    between = (F.col("_k1") - F.col("_at")) * F.col("_v0") + (F.col("_at") - F.col("_k0")) * F.col("_v1")
    return both.select(*group, F.when((F.col("_k0") == F.col("_k1")) | (F.col("_v0") == F.col("_v1")), F.col("_v0")).otherwise(between).alias("_value"))


def met(values: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    """Values in their group's brackets, a few per group; brackets are broadcast up to a bound, beyond it AQE splits what is hot."""
    renamed = spans.withColumnsRenamed({k: f"_r_{k}" for k in group})
    renamed = F.broadcast(renamed) if spans.count() <= BROADCAST_ROWS else renamed
    on = [values[k].eqNullSafe(renamed[f"_r_{k}"]) for k in group]
    return values.join(renamed, [*on, values["_v"] >= renamed["_lo"], values["_v"] <= renamed["_hi"]]).drop(*[f"_r_{k}" for k in group])
