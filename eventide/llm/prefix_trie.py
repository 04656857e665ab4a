"""The trie of all prefixes of conversations, by prefix doubling.

Two blocks of turns get one name if they are equal.  Turns are named first; a block of 2^(k+1) turns is
named by the pair of its halves' names, for all blocks that begin at a multiple of their length (``block_names``).  A prefix of d turns is d's
binary decomposition into such blocks, longest first: from the longest blocks down, each round names the prefixes
whose last block it is by the pair (name of the prefix before it, name of the block) (``prefix_names``).  Names are dense numbers.
So rounds follow the logarithm of the longest conversation, each turn is named three times, and no task holds a conversation.

A node is the rows (conversation, depth) of one name.  Sums over subtrees need no walk: a conversation owns the nodes whose smallest
member it is, which are the deep end of its path.  So the sum over the subtree of v is what its members own, less
what v's owner owns above v (``subtrees``).

Names are dealt by a join on pairs that a third of all rows may share: see ``looked_up``.  Long paths are summed in stretches.

Defined cases: a null role or text counts as empty; turns go by number, null first, equal numbers by a digest of role and text;
repeated rows are turns of their own; rows without conv_id belong to no conversation; an empty table has no nodes; other
columns are not read; conv_id is a whole number, and c % 5 has its sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import numbered_globally
from .common import looked_up, stored, text_or_empty

#: Turns that a conversation may take from the first of its five; ids that one row of a node's ends holds; turns of a path summed at once.
HEAD, STRETCH = 8, 4096


def named(rows: DataFrame, key: list[str], name: str, first: int, what: str) -> tuple[DataFrame, int]:
    """(rows with the number of their key, the number after the last): equal keys get equal numbers, dense from ``first``.

    ``rows`` is stored.  The number of a key is its place among the keys of its task, after those of the tasks before.
    """
    keys = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), f"trie-{what}-keys")
    # a row for each shuffle partition
    parts = sorted(keys.groupBy("_part").agg(F.min("_at").alias("at"), F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).collect())
    starts, before = [], first
    for p in parts:
        starts.append((p["_part"], before - p["at"]))
        before += p["keys"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _offset long")
    numbers = keys.join(F.broadcast(offsets), "_part").select(*key, (F.col("_at") + F.col("_offset")).alias(name), "_n")
    return looked_up(rows, numbers, key, "_n", sum(p["rows"] for p in parts), before - first), before


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): all turns, numbered through in order; texts stay where they are read."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    # equal rows are told apart by a number, so that the ranges may cut between them
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return numbered_globally(rows, "place", F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("_row")).drop("turn", "_row")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, i, name, bytes), (conv_id, rank, turns)): the rebuilt turns, from 0, by name, and all conversations in order."""
    placed = turns(conversations)
    each = stored(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("own")), "trie-conversations")
    total, keys = each.agg(F.sum("own"), F.count(F.lit(1))).head()
    named_turns, _ = named(stored(placed, "trie-turns"), ["digest"], "name", 0, "turn")
    at = stored(looked_up(stored(named_turns.drop("digest"), "trie-named"), each, ["conv_id"], "own", total or 0, keys).withColumn("i", F.col("place") - F.col("first")).drop("place", "first"), "trie-places")

    # at most HEAD turns of each conversation
    heads = at.where(F.col("i") < HEAD).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "name", "bytes"))).alias("head")).withColumnRenamed("conv_id", "base")
    borrows = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    known = each.withColumns({"h": borrows, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(heads, "base", "left")
    known = known.withColumn("head", F.when(F.col("head").isNull(), F.expr("array()").cast(heads.schema["head"].dataType)).otherwise(F.expr("slice(head, 1, cast(h as int))")))
    known = known.withColumn("taken", F.size("head").cast("long")).withColumn("turns", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    known = stored(known.select("conv_id", "own", "first", "h", "taken", "turns", "head"), "trie-known")

    own = looked_up(at, known.select("conv_id", "own", "h", "taken"), ["conv_id"], "own", total or 0, keys)
    own = own.where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "name", "bytes")
    lent = known.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.i", "x.name", "x.bytes")
    order = numbered_globally(known.select("conv_id", "turns"), "rank", F.asc("conv_id"))
    return stored(own.unionByName(lent), "trie-rebuilt"), order


def block_names(rows: DataFrame, longest: int) -> list[DataFrame]:
    """For each k the blocks of 2^k turns: (conv_id, i, name, bytes), the i-th of the conversation, with the bytes of its last text."""
    levels = [rows]
    while 2 << (len(levels) - 1) <= longest:
        half, odd = levels[-1], F.col("i") % 2 == 1
        pairs = half.groupBy("conv_id", F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"), F.max(F.when(odd, F.col("bytes"))).alias("bytes"))
        both, _ = named(stored(pairs.where("left is not null and right is not null"), "trie-pairs"), ["left", "right"], "name", 0, "block")
        levels.append(stored(both.select("conv_id", "i", "name", "bytes"), "trie-blocks"))
    return levels


def prefix_names(levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, node, bytes): the name of each prefix of at least one turn; the empty one has the name 0."""
    found: list[DataFrame] = []
    after = 1
    for k, blocks in reversed(list(enumerate(levels))):
        # a prefix of (2j + 1) 2^k turns ends with the block 2j
        last = blocks.where(F.col("i") % 2 == 0).select("conv_id", (F.col("i") * (1 << k)).alias("before"), F.col("name").alias("block"), "bytes")
        if found:
            known = reduce(DataFrame.unionByName, found).select("conv_id", F.col("depth").alias("before"), F.col("node").alias("prefix"))
            last = last.join(known, ["conv_id", "before"], "left").withColumn("prefix", F.coalesce("prefix", F.lit(0)))
        else:
            last = last.withColumn("prefix", F.lit(0).cast("long"))
        some, after = named(stored(last, "trie-last"), ["prefix", "block"], "node", after, "prefix")
        found.append(stored(some.select("conv_id", (F.col("before") + (1 << k)).alias("depth"), "node", "bytes"), "trie-prefixes"))
    return reduce(DataFrame.unionByName, found)


def ends(paths: DataFrame, order: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    Ids are joined in stretches of ``STRETCH`` ranks, each a row; the stretches of a node stream through one hash, which has no parts.
    """
    last = order.where("turns > 0").join(paths, [order["conv_id"] == paths["conv_id"], order["turns"] == paths["depth"]]).select(order["conv_id"], "rank", "node")
    last = last.unionByName(order.where("turns = 0").select("conv_id", "rank", F.lit(0).cast("long").alias("node")))
    stretch = F.floor(F.col("rank") / STRETCH)
    rows = last.groupBy("node", stretch.alias("stretch")).agg(F.expr("array_join(transform(array_sort(collect_list(conv_id)), x -> string(x)), ',')").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            nodes, digests = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        nodes.append(at)
                        digests.append(state.hexdigest())
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return rows.repartition("node").sortWithinPartitions("node", "stretch").mapInArrow(run, "node long, ends_sha256 string")


def owned_above(nodes: DataFrame) -> DataFrame:
    """(node, above): the sum of ``gain`` over the nodes of the same owner above each node, summed by stretches of the path."""
    stretch = F.floor(F.col("depth") / STRETCH)
    rows = nodes.select("node", "conv_id", "depth", "gain", stretch.alias("stretch"))
    before = F.coalesce(F.sum("gain").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("gain").alias("gain")).select("conv_id", "stretch", before.alias("_before"))
    within = F.coalesce(F.sum("gain").over(Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(sums, ["conv_id", "stretch"]).select("node", (F.col("_before") + F.col("_within")).alias("above"))


def subtrees(nodes: DataFrame, paths: DataFrame, order: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) of the nodes with two members or more; a node with one has one leaf and saves nothing."""
    total, keys = order.agg(F.sum(F.col("turns") + 1), F.count(F.lit(1))).head()
    owned = nodes.groupBy("conv_id").agg(F.sum("gain").alias("gain"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    owned = stored(order.select("conv_id", (F.col("turns") + 1).alias("_turns")).join(owned, "conv_id"), "trie-owned")
    members = stored(paths.select("conv_id", "node").unionByName(order.select("conv_id", F.lit(0).cast("long").alias("node"))), "trie-members")
    sums = looked_up(members, owned, ["conv_id"], "_turns", total or 0, keys).groupBy("node").agg(F.sum("gain").alias("gain"), F.sum("leaves").alias("n_leaves"))
    shared = nodes.where("n_convs > 1")
    return owned_above(shared).join(sums, "node").select("node", "n_leaves", (F.col("gain") - F.col("above")).alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie of the rebuilt conversations."""
    rows, order = rebuilt(conversations)
    order = stored(order, "trie-order")
    longest = order.agg(F.max("turns")).head()[0] or 0
    paths = prefix_names(block_names(rows, longest))

    nodes = paths.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = nodes.join(up, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0)))
    root = order.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"), "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("parent"))
    nodes = stored(nodes.unionByName(root), "trie-nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "gain": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = stored(nodes, "trie-counted")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = nodes.where("parent is not null").withColumnRenamed("n_children", "children")
    below = looked_up(below, parents, ["parent"], "n_children", nodes.count(), parents.count())
    whole = below.unionByName(nodes.where("parent is null").withColumnRenamed("n_children", "children").withColumn("parent_conv_id", F.lit(None).cast("long")))

    whole = whole.join(subtrees(nodes, paths, order), "node", "left").join(ends(paths, order), "node", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
