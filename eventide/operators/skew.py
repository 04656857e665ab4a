"""Joins with small and large key tables in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Keys that are broadcast at most, of about 100 bytes each.
BROADCAST_ROWS = 200_000
#: A key is hot if it has over this part of all rows, so there are no more hot keys than this.
HOT_KEYS = 10_000
#: The tasks that a hot key's rows are dealt to where its row in the other table is too wide to broadcast.
SALTS = 16


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, keys: int) -> DataFrame:
    """``rows`` joined with ``table``, which is stored and has one of its ``keys`` rows for each key of ``rows``; ``weight`` says how many rows have the key, of ``total``.

    Small tables are broadcast.  Of larger ones only the hot keys are, ``HOT_KEYS`` at most; the others are joined by a
    shuffle in which no key has over a ten-thousandth of the rows.  ``rows`` is read twice then, so it should be stored.
    """
    if keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(weight)), on)
    hot = F.col(weight) * HOT_KEYS > total
    mark = rows.join(F.broadcast(table.where(hot).select(*on, F.lit(True).alias("_hot"))), on, "left")
    first = rows.join(F.broadcast(table.where(hot).drop(weight)), on)
    return first.unionByName(mark.where("_hot is null").drop("_hot").join(table.where(~hot).drop(weight), on))


def spread_join(rows: DataFrame, table: DataFrame, on: str, counted: DataFrame) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``on``, of any width.

    The rows of a hot key are dealt to ``SALTS`` tasks, and its row of ``table`` stands in each of them; other keys stand once.
    Only the hot keys themselves are broadcast, ``HOT_KEYS`` at most.  ``counted`` is a stored table of the columns
    that tell the rows apart; ``rows`` has them too, and is read once.
    """
    counts = counted.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    hot = stored(counts.where(F.col("_n") * HOT_KEYS > counted.count()).where(F.col("_n") > SALTS).select(on, F.lit(True).alias("_hot")), "hot-keys")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*counted.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(every))
    return dealt.drop("_hot").join(copies.drop("_hot"), [on, "_salt"]).drop("_salt")
