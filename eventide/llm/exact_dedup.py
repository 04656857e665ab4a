"""Exact duplicates by progressive refinement, with DataFrame functions only.

Rows are told apart by the length of the white-space-normalised text, then by a
hash of its first characters, and only groups that are still shared are hashed in
full.  Each level is a partial aggregation over narrow rows, so a group of copies
with a third of all rows is summed before it is shuffled.  What the levels find is joined
back by broadcast where it is small, and else by salted keys, so no group lands in one task.

Defined cases: null text counts as empty, and all empty texts form one group.
In ``duplicate_groups`` rows that repeat an id are all marked kept if that id is the
keeper's; a null id counts as larger than any other, and a group of null ids only has a
null ``keep_id`` and keeps all its rows.  ``without_duplicates`` leaves one row of each
group, whatever its ids are.  An empty table gives an empty result.  Columns other than the two
named are not read; result columns replace none of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, joined, stored, text_or_empty, whole


def normalised(text: str | Column) -> Column:
    """The text with every run of ASCII white space as one space."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def prefix_hash(norm: Column, chars: int) -> Column:
    """A hash of the length and the first characters, so that one column names a group of both levels."""
    return F.xxhash64(F.length(norm), F.substring(norm, 1, chars)).alias("_prefix")


def shared_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The key values that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def levels(facts: DataFrame) -> DataFrame:
    """(_prefix): the prefix hashes that rows of ``facts`` (_len, _prefix) share, among those whose length is shared."""
    lengths = stored(shared_keys(facts, "_len"), "dedup-lengths")  # as many as there are lengths, whatever the rows
    return shared_keys(joined(facts, lengths, "_len", "left_semi"), "_prefix")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digests: bool = False) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept and text_sha256.

    ``text_sha256`` is null for documents that an earlier level has already shown to be alone, unless ``digests``
    asks for it on all rows; it is then made in the pass that makes the other facts, as no pass can be saved.
    """
    norm = normalised(text_col)
    facts = docs.select(F.col(id_col).alias("_id"), F.length(norm).alias("_len"), prefix_hash(norm, prefix_chars), *([F.sha2(norm.cast("binary"), 256).alias("_sha")] if digests else []))
    if digests:
        facts = stored(facts, "dedup-facts")
        shared = stored(levels(facts), "dedup-prefixes")
        # a group of copies is one row of these counts, summed before it is shuffled
        counts = facts.groupBy("_prefix", "_sha").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
        groups = stored(counts.join(shared, "_prefix", "left_semi").select("_sha", "_keep", "_size"), "dedup-groups")
        found = joined(facts, groups, "_sha", "left")
    else:
        open_groups = stored(levels(facts), "dedup-prefixes").withColumn("_open", F.lit(True))
        marked = joined(docs.select(F.col(id_col).alias("_id"), prefix_hash(norm, prefix_chars), norm.alias("_norm")), open_groups, "_prefix", "left")
        # only rows of groups that are still open are hashed in full
        hashed = stored(marked.select("_id", F.when(F.col("_open"), F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha")), "dedup-facts")
        groups = stored(hashed.where("_sha is not null").groupBy("_sha").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1"), "dedup-groups")
        found = joined(hashed, groups, "_sha", "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return found.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, of which each distinct text keeps one row: one of the smallest id, nulls last.

    Rows that no other row resembles by length and prefix pass by without a full hash; the others are hashed and
    go through one aggregation, partial before its shuffle, so a group sends one row from each task.
    """
    norm = normalised(text_col)
    open_groups = stored(levels(docs.select(F.length(norm).alias("_len"), prefix_hash(norm, prefix_chars))), "dedup-prefixes").withColumn("_open", F.lit(True))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("_order")
    rows = joined(docs.select(prefix_hash(norm, prefix_chars), order, norm.alias("_norm"), whole(docs).alias("_all")), open_groups, "_prefix", "left")
    # rows are read once for each side: to write them down in between would cost a copy of the table
    firsts = rows.where("_open").groupBy(F.sha2(F.col("_norm").cast("binary"), 256)).agg(F.min_by("_all", "_order").alias("_all"))
    return rows.where("_open is null").select("_all.*").unionByName(firsts.select("_all.*"))
