"""Near duplicates by the similarity of word shingles: SimHash links and MinHash bands, every link verified.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is
``SIMILARITY`` or more.  Candidates are what ``simhash`` links by fingerprints of three differing bits at most; less similar
texts differ in more bits than its keys can cover, so candidates also meet in ``BANDS`` buckets, each keyed by ``ROWS`` minima
of the hashed shingles: a pair of similarity 0.8 shares a bucket with probability 0.9996.
A bucket of up to ``SMALL`` rows offers all its pairs; a larger one first offers each row with
``FLIPS``' number of hubs, rows that are the same wherever the same rows meet.  Every offered pair is checked on
the whole shingle sets, and groups are the components of what was verified.  Where a large bucket's rows
are then still in several groups, the rows outside its largest group are compared with all its rows,
in tiles of bounded size, so no pair of a bucket goes unchecked unless its rows are in one group already.

A group's ends may be less alike than a link.

Defined cases: a text of fewer words than a shingle is one shingle; null and word-free texts
are alike; a row is known by its number, so null and repeated ids take part like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import simhash
from .common import drop_stored, first_of, looked_up, numbered, spread_join, stored, text_or_empty

SIMILARITY, WIDTH = 0.8, 5
BANDS, ROWS, SMALL = 20, 5, 16
#: Rows that a tile of a large bucket has on each side, about.
TILE = 512
FLIPS = (0, 0x2AAAAAAAAAAAAAAA, 0x1B4E81B4E81B4E81, 0x3FFFFFFFFFFFFFFF)
SLICE = 1 << 12

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] << np.uint64(1) | np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, letters A-Z lower-cased."""
    words = data.lower().split()
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in runs), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The key of each band, as signed integers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), SLICE):
        mixed = hashes[i : i + SLICE] * FACTORS + SHIFTS
        np.minimum(least, mixed.min(axis=1), out=least)
    raw = least.astype("<u8").tobytes()
    step = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) - (1 << 63) for b in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows of (_row, data): pairs (a, b), a < b, of row numbers to check first, and (key, row) of the large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(shingles(x.as_buffer().to_pybytes())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["row", "keys"])

    bands = stored(texts.mapInArrow(run, "row long, keys array<long>"), "near-bands")
    entries = bands.select("row", F.explode("keys").alias("key"))
    # the least row number after some of its bits are flipped
    hubs = [F.min(F.col("row").bitwiseXOR(F.lit(flip))).bitwiseXOR(F.lit(flip)) for flip in FLIPS]
    buckets = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(*hubs).alias("hubs")).where("n > 1"), "near-buckets")
    few = entries.join(buckets.where(f"n <= {SMALL}").select("key"), "key").groupBy("key").agg(F.collect_list("row").alias("rows"))
    all_pairs = few.select(F.explode("rows").alias("x"), "rows").select("x", F.explode("rows").alias("y"))
    starred = entries.join(buckets.where(f"n > {SMALL}").select("key", "hubs"), "key").select(F.col("row").alias("x"), F.explode("hubs").alias("y"))
    pairs = all_pairs.unionByName(starred).where("x <> y")
    out = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-pairs")
    large = stored(entries.join(buckets.where(f"n > {SMALL}").select("key"), "key"), "near-large")
    drop_stored(bands, buckets)
    return out, large


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """For rows of (_row, data): pairs (a, b), a < b, that connect all rows which SimHash links."""
    prints = stored(simhash.fingerprints(texts.select("_row", F.col("data").cast("string").alias("text")), "_row", "text"), "near-fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")), "near-distinct")
    total, keys = distinct.agg(F.sum("n"), F.count(F.lit(1))).head()
    same = looked_up(prints, distinct, ["fp"], "n", total or 0, keys).select(F.col("_row").alias("x"), F.col("first").alias("y"))
    first = lambda c: distinct.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    links = simhash.verified_links(distinct.select("fp")).join(first("a"), "a").join(first("b"), "b").select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    return same.unionByName(links).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose whole shingle sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                for row, data in ((a, x), (b, y)):
                    if row not in known:
                        known[row] = shingles(data.as_buffer().to_pybytes())
                keep.append(similarity(known[a], known[b]) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = [texts.select(F.col("_row").alias(c), F.col("data").alias(f"data_{c}")) for c in "ab"]
    # a hub is in as many pairs as its buckets have rows
    return spread_join(spread_join(pairs, sides[0], "a", pairs), sides[1], "b", pairs).select("a", "b", "data_a", "data_b").mapInArrow(run, "a long, b long")


def open_buckets(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, row, root, outside, blocks, outer_blocks): the rows of large buckets that are in several groups.

    ``outside`` tells the rows that are not in the bucket's largest group.
    """
    members = large.join(roots, large["row"] == roots["node"], "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    per = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    several = per.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("groups > 1")
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    several = stored(several.select("key", F.col("n").alias("_n"), F.col("top.root").alias("main"), tiles(F.col("n")).alias("blocks"), tiles(F.col("n") - F.col("top.n")).alias("outer_blocks")), "near-several")
    total, keys = several.agg(F.sum("_n"), F.count(F.lit(1))).head()
    return looked_up(members, several, ["key"], "_n", total or 0, keys).select("key", "row", "root", (F.col("root") != F.col("main")).alias("outside"), "blocks", "outer_blocks")


def remaining_links(rows: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b): roots of linked groups of ``open_buckets``, each tile's enough to connect the groups that it links.

    A tile (i, j) of a bucket compares the i-th block of its outside rows with the j-th block of all its rows.
    """
    data = rows.join(texts, rows["row"] == texts["_row"]).drop("_row")
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = data.where("outside").select("key", block("outer_blocks").alias("i"), every("blocks").alias("j"), F.lit(1).alias("side"), "row", "root", "data")
    inner = data.select("key", every("outer_blocks").alias("i"), block("blocks").alias("j"), F.lit(0).alias("side"), "row", "root", "data")
    dealt = outer.unionByName(inner).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, out = None, Tile(least), []
        for batch in batches:
            ids = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "root")), strict=True)
            for (key, i, j, side, root), data in zip(ids, batch.column("data"), strict=True):
                if (key, i, j) != at:
                    at, tile = (key, i, j), Tile(least)
                found = shingles(data.as_buffer().to_pybytes())
                out += tile.links(root, found) if side else tile.add(root, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []

    return dealt.mapInArrow(run, "a long, b long")


class Tile:
    """Rows that later rows are compared with, through an index of their shingles; knows which groups are linked."""

    def __init__(self, least: float):
        self.least = least
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.parent: dict[int, int] = {}

    def add(self, root: int, found: np.ndarray) -> list:
        self.roots.append(root)
        self.sets.append(found)
        return []

    def find(self, root: int) -> int:
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        return root

    def links(self, root: int, found: np.ndarray) -> list[tuple[int, int]]:
        if not self.sets:
            return []
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            hashes = np.concatenate(self.sets)
            order = np.argsort(hashes, kind="stable")
            self.index = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        hashes, owner, sizes = self.index
        lo, hi = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
        spans = hi - lo
        at = np.repeat(lo - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
        both = np.bincount(owner[at], minlength=len(sizes))
        out = []
        for k in np.flatnonzero(both >= self.least * (sizes + len(found) - both)).tolist():
            a, b = self.find(root), self.find(self.roots[k])
            if a != b:
                self.parent[a] = b
                out.append((root, self.roots[k]))
        return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group: that of the smallest id, nulls last."""
    rows = numbered(docs, "near-rows")
    texts = rows.select("_row", text_or_empty(F.col("_all")[text_col]).cast("binary").alias("data"))
    by_bands, large = candidates(texts)
    pairs = stored(fingerprint_pairs(texts).unionByName(by_bands).distinct(), "near-offered")
    drop_stored(by_bands)
    links = stored(verified(pairs, texts), "near-links")
    drop_stored(pairs)
    roots = stored(components(links), "near-roots")
    still = stored(open_buckets(large, roots), "near-open")
    if not still.isEmpty():
        more = stored(remaining_links(still, texts), "near-more")
        # the groups themselves are the nodes now, so this graph is small
        again = stored(components(more).select(F.col("node").alias("root"), F.col("root").alias("wider")), "near-wider")
        alone = again.join(roots, again["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("wider").alias("root"))
        roots = stored(roots.join(again, "root", "left").select("node", F.coalesce("wider", "root").alias("root")).unionByName(alone), "near-roots")
    drop_stored(links, large, still)
    ids = rows.select(F.col("_row").alias("node"), F.col("_all")[id_col].alias("_id"))
    known = stored(roots.join(ids, "node"), "near-groups")
    kept = known.groupBy("root").agg(first_of(F.col("_id"), F.col("node")).alias("node")).select("node")
    gone = known.join(kept, "node", "left_anti").select(F.col("node").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select("_all.*")
