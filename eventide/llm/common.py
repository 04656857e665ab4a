"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import BROADCAST_ROWS, looked_up, spread_join
from ..sources.storage import drop_stored, shared_folder, stored, work_path

__all__ = ["drop_stored", "first_of", "fold", "joined", "looked_up", "numbered", "shared_folder", "shuffle_width", "spread_join", "stored", "text_or_empty", "whole", "work_path"]

#: One run of the ASCII white space that the text contracts name.
SPACES = "[\\x20\\x09-\\x0D]+"


#: The tasks that a key's rows are dealt to where keys aren't broadcast.
SALTS = 16


def joined(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` joined with ``keys``, a stored table with one row for each ``on``.

    Up to ``BROADCAST_ROWS`` keys are broadcast; more are joined by a shuffle in which every key
    stands ``SALTS`` times, so a hot key's rows are dealt to as many tasks.
    """
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(_row, _all): each row of ``docs`` as a struct with a number of its own, written once so that it stays.

    Ids may be null or repeat, so what is decided for a row is joined back by this number.
    """
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), whole(docs).alias("_all")), name)


def whole(docs: DataFrame) -> Column:
    """The row as a struct."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def first_of(id_col: Column, row: Column) -> Column:
    """Aggregate: the row number of the smallest id, nulls last; of equal ids the smallest number."""
    return F.min(F.struct(id_col.isNull().alias("none"), id_col.alias("id"), row.alias("row")))["row"]


def text_or_empty(col: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''. """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
