"""SimHash near-duplicates found through deletion-variant signatures.

A fingerprint of ``bits`` bits and at most ``radius`` differing bits is cut into
``radius // 2 + 1`` segments, so that some segment of any linked pair differs by at
most one bit.  For each segment the exact value and every value with one bit left
out are index keys.  Two segments that are equal meet under the exact key; two that
differ in one bit meet under the key that leaves it out, on its two sides.  So a
left-out key needs work only where both sides occur, and only between the sides.

Equal fingerprints are merged before anything else, so copies cost one index entry.
A key with few members is compared in one tile; one with many is dealt into tiles of
bounded size that each compare two blocks of members, so no task gathers a whole hot
key.  A tile returns the spanning forest of the links it verified, never all pairs:
the components are the same and the rows stay linear.

Defined cases: null and word-free texts have fingerprint zero and are linked like any
other; rows with the same text, and repeated rows, share a component; a row with a
null id takes part and reports its component, but a null is never a component id
unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import drop_stored, first_of, looked_up, numbered, shuffle_width, stored, text_or_empty

#: Members of an index key that one tile compares; a tile never holds more than twice as many.
TILE = 1024
SLICE = 1 << 15
#: Fingerprints that a task turns into index entries at most.
ROWS = 100_000


def simhash(data: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8, as a signed integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``width`` words with repeats included (the whole sequence if it is shorter).  A bit
    is set if it is set in over half of the shingles' XXH64 with seed 42.
    """
    words = data.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): the signed 64-bit fingerprint of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((simhash(x.as_buffer().to_pybytes(), width) for x in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    raw = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("data"))
    return raw.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def variant_keys(fps: DataFrame, radius: int = 3, bits: int = 64) -> DataFrame:
    """(key, side, fp): index entries; side is -1 for exact keys, else the bit left out."""
    segments = radius // 2 + 1
    edges = [round(i * bits / segments) for i in range(segments + 1)]
    entries = []
    for s, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        wide = hi - lo
        value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << wide) - 1)) if wide < 64 else F.col("fp")
        tag = lambda at, s=s: F.lit((s * 65 + at) & 0xFFFF)
        entries.append(F.struct(F.xxhash64(tag(64), value).alias("key"), F.lit(-1).alias("side")) if wide > 56 else F.struct(F.shiftleft(tag(64).cast("long"), 40).bitwiseXOR(value).alias("key"), F.lit(-1).alias("side")))
        for bit in range(wide):
            rest = value.bitwiseAND(F.lit(~(1 << bit)))
            key = F.xxhash64(tag(bit), rest) if wide > 40 else F.shiftleft(tag(bit).cast("long"), 40).bitwiseXOR(rest)
            entries.append(F.struct(key.alias("key"), F.shiftrightunsigned(value, bit).bitwiseAND(F.lit(1)).cast("int").alias("side")))
    return fps.select("fp", F.inline(F.array(*entries)))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    nodes = (left if right is None else np.concatenate([left, right])).view(np.uint64)  # bitwise_count takes the magnitude of signed numbers
    n, m = len(nodes), len(left)
    open_, links = np.ones(n, bool), []
    for start in range(n):
        if not open_[start]:
            continue
        open_[start] = False
        frontier = [start]
        while frontier:
            at = frontier.pop()
            lo, hi = (0, n) if right is None else (m, n) if at < m else (0, m)
            near = np.flatnonzero((np.bitwise_count(nodes[lo:hi] ^ nodes[at]) <= radius) & open_[lo:hi]) + lo
            open_[near] = False
            links += [(at, int(x)) for x in near]
            frontier += near.tolist()
    signed = nodes.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in links]


def verified_links(fps: DataFrame, radius: int = 3, bits: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect all that are linked.

    ``fps`` has one row per distinct ``fp``, in a stored table; its rows are dealt out evenly before each becomes
    as many entries as it has bits.
    """
    entries = variant_keys(fps.repartition(max(shuffle_width(fps.sparkSession), -(-fps.count() // ROWS))), radius, bits)
    size = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 0).alias("zeros"), F.count_if(F.col("side") == -1).alias("exact"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    busy = stored(size.where("(exact > 1) or (exact = 0 and zeros > 0 and zeros < n)"), "simhash-keys")
    pairs = busy.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("lo").alias("a"), F.col("hi").alias("b"))

    large = busy.where("n > 2").select("key", "n", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    large = stored(large, "simhash-large")
    total, keys = large.agg(F.sum("n"), F.count(F.lit(1))).head()
    members = looked_up(entries, large.withColumn("_n", F.col("n")), ["key"], "_n", total or 0, keys)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    dealt = members.select("key", "side", "fp", block.alias("block"), F.inline(F.array_distinct(tiles)))
    spread = dealt.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in _runs(frames, held):
            links = []
            for (_, i, j), tile in frame.groupby(["key", "i", "j"], sort=False):
                links += _tile_links(tile, i, j, radius)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return pairs.unionByName(spread.mapInPandas(run, "a long, b long"))


def _runs(frames: Iterator[pd.DataFrame], held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole tiles: the last tile of each batch waits for the next batch."""
    for frame in frames:
        if frame.empty:
            continue
        last = frame.iloc[-1]
        same = ((frame["key"] == last["key"]) & (frame["i"] == last["i"]) & (frame["j"] == last["j"])).to_numpy()
        cut = len(same) if same.all() else len(same) - int(np.argmin(same[::-1]))
        if same.all():
            if held and not _same_tile(held[0].iloc[0], last):
                yield pd.concat(held)
                held.clear()
            held.append(frame)
            continue
        yield pd.concat([*held, frame.iloc[:cut]])
        held[:] = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held)


def _same_tile(a: pd.Series, b: pd.Series) -> bool:
    return a["key"] == b["key"] and a["i"] == b["i"] and a["j"] == b["j"]


def _tile_links(tile: pd.DataFrame, i: int, j: int, radius: int) -> list[tuple[int, int]]:
    fp, side, block = tile["fp"].to_numpy(np.int64), tile["side"].to_numpy(), tile["block"].to_numpy()
    if side[0] == -1:
        return forest(fp, None, radius) if i == j else forest(fp[block == i], fp[block == j], radius)
    if i == j:
        return forest(fp[side == 0], fp[side == 1], radius)
    return forest(fp[(side == 0) & (block == i)], fp[(side == 1) & (block == j)], radius) + forest(fp[(side == 1) & (block == i)], fp[(side == 0) & (block == j)], radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id reachable over links of ``radius`` bits."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    links = stored(verified_links(distinct.select("fp"), radius), "simhash-links")
    roots = components(links)
    drop_stored(links)
    least = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stored(least.select("fp", "root", "n").join(names, "root").select("fp", "component_id", "n"), "simhash-components")
    total, keys = by_print.agg(F.sum("n"), F.count(F.lit(1))).head()
    return looked_up(prints, by_print, ["fp"], "n", total or 0, keys).select(id_col, "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the smallest id, nulls last."""
    rows = numbered(docs, "simhash-rows")
    found = near_duplicates(rows.select("_row", F.col("_all")[text_col].alias("_text")), "_row", "_text", radius)
    ids = rows.select("_row", F.col("_all")[id_col].alias("_id"))
    kept = found.join(ids, "_row").groupBy("component_id").agg(first_of(F.col("_id"), F.col("_row")).alias("_row")).select("_row")
    return rows.join(kept, "_row", "left_semi").select("_all.*")
