"""Sequential folds over sorted groups: what is emitted depends on the row before, so rows go by in order.

Each key's rows meet in one task, sorted by Spark (which spills), and pass in Arrow batches; only the fold's own
small state is held, so a key with a third of all rows costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Fold = Callable[[dict], Iterable[tuple]]


def folded(rows: DataFrame, keys: list[str], order: list[str], new: Callable[[], Fold], schema: str, flush: int = 4096, whole: dict[str, Column] | None = None) -> DataFrame:
    """Rows that each key's fold emits, in order of ``order``; ``new`` makes the fold of a key.

    ``whole`` are aggregates over all rows of a key, which its fold finds in each row.  They are made where the rows have met, so nothing
    moves twice; Spark holds a key's rows for them, and spills what is too much.

    A fold takes a row as a dict and returns tuples of ``schema`` without the keys, which are put in front.
    """
    every = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.repartition(*keys).withColumns({c: agg.over(every) for c, agg in (whole or {}).items()})
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    full = ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema])
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if fold is None or key != at:
                    at, fold = key, new()
                out += [key + x for x in fold(row)]
                if len(out) >= flush:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, full)
