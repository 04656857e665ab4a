"""Phrases whose words stand together more often than their parts would by chance.

1. Texts are cut into pieces at marks, and identical pieces become one row with a multiplicity (``pieces``).
2. Words and word pairs are counted, weighted by multiplicity, under 44-bit cells of their hashes: each task sends a bucket of cells as
   one packed row, and DuckDB adds up each bucket, out of core.  A cell's sum is no less than the count of any word or pair in it, so
   cells under ``least`` hold no phrase.  The others are marked in a bitmap of at most 64 MB: a fuller bitmap
   lets more through, but loses nothing (``marked_cells``).
3. Words, and phrases all of whose words and pairs are marked, are counted by their text, exactly, again in DuckDB by hash bucket (``phrase_counts``).
4. Each cut of a candidate asks for the counts of its two parts.  Requests are shuffled to the parts; a part that many ask
   for stands in several copies (``joined``).  A longer candidate tells the two phrases one word shorter its count: a phrase that
   is never met outside a longer one has the count of one of just one word more, so this finds all that go.

Pieces carry one space after each word, so all words of an Arrow column are one offset array over its bytes, and a task
names words and phrases by exact dictionary codes before anything is hashed or sent.

Defined cases: a null text counts as empty, a null language as ``und``; ids aren't read, so repeated rows and rows without id
count like any others; equal scores go by count, then by the phrase's bytes; an empty table, or one without phrases, gives an empty result; a
piece of any length is one row.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, joined, shared_folder, shuffle_width, stored, text_or_empty

MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, tabs to spaces, marks to line ends.
FOLDED = bytes(10 if c in MARKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that a task works on at once, and cells that it gathers before it sends them.
CHUNK, FLUSH = 2 << 20, 2 << 20
CELL_BITS, MAP_BITS = 44, 29
#: Cells that one DuckDB bucket takes in, and its memory before it spills.
BUCKET, MEMORY = 2 << 20, "300MB"
#: Salted ranges in which the first phrases of a language are looked for before they meet.
RANGES = 64

#: In decimals of 38 digits: exact for counts of up to 17 digits.
SCORE = "(cast(a as decimal(17)) * cast(n as decimal(17)) * 1000) div (cast(l as decimal(18)) * cast(r as decimal(18)))"


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, words, m): distinct pieces, a space after each word, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            found: dict[tuple[str, bytes], int] = {}
            size = 0
            for lang, text in zip(langs, batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes().translate(FOLDED)
                size += len(data)
                untidy = b"  " in data
                for piece in data.split(b"\n"):
                    piece = b" ".join(piece.split()) if untidy else piece.strip(b" ")
                    if piece:
                        key = (lang, piece)
                        found[key] = found.get(key, 0) + 1
                if size > CHUNK:
                    yield packed(found)
                    found, size = {}, 0
            if found:
                yield packed(found)

    def packed(found: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        langs, texts = zip(*found, strict=True) if found else ((), ())
        data = pa.array([t + b" " for t in texts], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), data, pa.array([t.count(b" ") + 1 for t in texts], pa.int32()), pa.array(found.values(), pa.int64())], names=["lang", "piece", "words", "m"])

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    raw = docs.select(lang.alias("lang"), text_or_empty(text_col).cast("binary").alias("data"))
    return raw.mapInArrow(run, "lang string, piece string, words int, m long").groupBy("lang", "piece", "words").agg(F.sum("m").alias("m"))


class Words:
    """All words of a chunk of pieces, in order: exact codes, and what their hashes and their pairs' hashes are."""

    def __init__(self, langs: pa.Array, texts: pa.Array, words: np.ndarray, m: np.ndarray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        ends = np.flatnonzero(self.data[offsets[0] :] == 32) + offsets[0] + 1
        self.bounds = np.concatenate([offsets[:1], ends]).astype(np.int32)  # word i and its space: bounds[i] to bounds[i + 1]
        spelt = pa.StringArray.from_buffers(len(ends), pa.py_buffer(self.bounds), texts.buffers()[2]).dictionary_encode()
        self.codes = np.asarray(spelt.indices).astype(np.int64)
        self.spelling = spelt.dictionary
        kinds = langs.dictionary_encode()
        self.langs = kinds.dictionary.to_pylist()
        self.lang = np.repeat(np.asarray(kinds.indices), words)  # of each word, as are m and joins
        self.m = np.repeat(m, words)
        piece = np.repeat(np.arange(len(words)), words)
        self.joins = piece[1:] == piece[:-1]  # word i and the next are of one piece
        seeds = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)
        hashes = pd.util.hash_array(self.spelling.to_numpy(zero_copy_only=False)) if len(self.spelling) else np.zeros(0, np.uint64)
        self.hash = mixed(hashes[self.codes] ^ (seeds[self.lang] * np.uint64(0x9E3779B97F4A7C15)))
        self.pair = mixed(self.hash[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + self.hash[1:])

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each language's distinct words in the chunk: its first place, and its count."""
        key = self.lang * np.int64(len(self.spelling) or 1) + self.codes
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return first, total(inverse, self.m, len(first))


def total(groups: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums by group, in whole numbers."""
    found = np.zeros(n, np.int64)
    np.add.at(found, groups, weights)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The pieces of a task, some megabytes at a time."""
    held: list[pa.RecordBatch] = []

    def all_held() -> Words:
        lang, piece, words, m = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
        held.clear()
        return Words(lang, piece, words.to_numpy(), m.to_numpy())

    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.schema.field(1).type != pa.string():
            raise TypeError("pieces must be an Arrow string column with 32-bit offsets")
        held.append(batch)
        if sum(b.column(1).nbytes for b in held) > CHUNK:
            yield all_held()
    if held:
        yield all_held()


def planes(x: np.ndarray, width: int) -> bytes:
    """Whole numbers as byte planes, lowest first: the high ones are mostly zero, and compress away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    found = np.zeros((len(data) // width, 8), np.uint8)
    found[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return found.reshape(-1).view("<u8").copy()


def summed(cells: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the sum of each."""
    order = np.argsort(cells)
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    return cells[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def packed_cells(bucket_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends the cells of words and word pairs: a row for each bucket and flush, cells as differences."""
    shift = np.uint64(CELL_BITS - bucket_bits)

    def rows(cells: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        cells, weights = summed(cells, weights)
        bucket = (cells >> shift).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        steps = np.diff(cells, prepend=np.uint64(0))
        steps[starts] = cells[starts] & ((np.uint64(1) << shift) - np.uint64(1))
        ends = [*starts[1:].tolist(), len(cells)]
        spans = list(zip(starts.tolist(), ends, strict=True))
        columns = [pa.array(bucket[starts], pa.int32()), pa.array([planes(steps[a:b], 6) for a, b in spans], pa.binary()), pa.array([planes(weights[a:b], 8) for a, b in spans], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "cells", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for w in chunks(batches):
            first, n = w.counted()
            held += [(cell(w.hash[first]), n), (cell(w.pair[w.joins]), w.m[:-1][w.joins])]
            size += len(first) + int(w.joins.sum())
            if size > FLUSH:
                yield rows(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield rows(*map(np.concatenate, zip(*held, strict=True)))

    return run


def cell(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CELL_BITS)


def spill_folder(spark: SparkSession) -> str | None:
    """Where DuckDB may spill: the shared folder, if it is a mounted path; else a bucket, which is sized for it, stays in memory."""
    folder = shared_folder(spark)
    return folder.removeprefix("file:").replace("//", "/") + "/eventide" if folder.startswith(("file:", "/")) else None


def in_duckdb(batches: Iterator[pa.RecordBatch], schema: pa.Schema, sql: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    """The rows of a query over ``source``, the stream of a task's batches; DuckDB pulls them and spills beyond its memory."""
    import duckdb

    own = f"{folder}/spill-{uuid.uuid4().hex}" if folder else ""
    con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": own, "preserve_insertion_order": False})
    try:
        con.register("source", pa.RecordBatchReader.from_batches(schema, batches))
        yield from con.sql(sql).to_arrow_reader(100_000)
    finally:
        con.close()
        if own and os.path.isdir(own):
            shutil.rmtree(own, ignore_errors=True)


def marked_cells(cut: DataFrame, words: int, least: int) -> tuple[np.ndarray, int]:
    """(bitmap, bits): where the cells that sum up to ``least`` are marked, by the cell's remainder."""
    spark = cut.sparkSession
    buckets = 1 << max(0, (-(-2 * words // BUCKET) - 1).bit_length(), (shuffle_width(spark) - 1).bit_length())
    bucket_bits, folder = buckets.bit_length() - 1, spill_folder(spark)
    sent = cut.select("lang", "piece", "words", "m").mapInArrow(packed_cells(bucket_bits), "bucket int, cells binary, weights binary")
    schema = pa.schema([("cell", pa.uint64()), ("w", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, cells, weights in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    base = np.uint64(bucket) << np.uint64(CELL_BITS - bucket_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(from_planes(cells, 6)) + base), pa.array(from_planes(weights, 8).astype(np.int64))], schema=schema)

        yield from in_duckdb(plain(), schema, f"select cell::bigint as cell from source group by cell having sum(w) >= {least}", folder)

    frequent = stored(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(count, "cell long"), "collocation-cells")
    bits = 1 << min(MAP_BITS, max(16, (64 * frequent.count()).bit_length()))
    place = F.pmod("cell", F.lit(bits)) + 1
    # rows of 4 kB, 64 MB at most
    rows = frequent.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in rows:
        bitmap[(r["k"] - 1) * 4096 :][:4096] = np.frombuffer(r["b"], np.uint8)
    drop_stored(frequent)
    return bitmap, bits


def phrase_counts(cut: DataFrame, words: int, least: int, longest: int) -> DataFrame:
    """(lang, phrase, words, a): all phrases of up to ``longest`` words that occur ``least`` times, with their counts."""
    spark = cut.sparkSession
    bitmap, bits = marked_cells(cut, words, least)
    marks, folder = spark.sparkContext.broadcast(bitmap), spill_folder(spark)

    def marked(hashes: np.ndarray) -> np.ndarray:
        at = cell(hashes) & np.uint64(bits - 1)
        return (marks.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def spelt(w: Words, first: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words at the places, without the last space."""
        lo, hi = w.bounds[first].astype(np.int64), w.bounds[first + n].astype(np.int64) - 1
        offsets = np.concatenate([[0], np.cumsum(hi - lo)])
        at = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], hi - lo)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(w.data[at]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in chunks(batches):
            first, n = w.counted()
            keep = marked(w.hash[first])
            yield batch(w, first[keep], n[keep], 1)
            known = marked(w.hash)
            pairs = w.joins & known[:-1] & known[1:]
            pairs[pairs] = marked(w.pair[pairs])
            # places where a phrase of ``size`` words begins, and its exact name in this chunk
            at, name = np.flatnonzero(known), w.lang.astype(np.int64)[known] * len(w.spelling) + w.codes[known]
            for size in range(2, longest + 1):
                keep = at + size - 1 < len(w.codes)
                keep[keep] = pairs[at[keep] + size - 2]
                at, name = at[keep], name[keep]
                if not len(at):
                    break
                _, name = np.unique(name, return_inverse=True)
                _, first, name = np.unique(name.astype(np.int64) * len(w.spelling) + w.codes[at + size - 1], return_index=True, return_inverse=True)
                yield batch(w, at[first], total(name, w.m[at], len(first)), size)

    def batch(w: Words, first: np.ndarray, counts: np.ndarray, n: int) -> pa.RecordBatch:
        langs = pa.DictionaryArray.from_arrays(pa.array(w.lang[first]), pa.array(w.langs, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([langs, spelt(w, first, n), pa.array(np.full(len(first), n), pa.int32()), pa.array(counts)], names=["lang", "phrase", "words", "w"])

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("w", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql = f"select lang, phrase, words, sum(w)::bigint as a from source group by all having sum(w) >= {least}"
        yield from in_duckdb((pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches), schema, sql, folder)

    sent = cut.select("lang", "piece", "words", "m").mapInArrow(send, "lang string, phrase string, words int, w long")
    width = max(shuffle_width(spark), -(-words // BUCKET))
    return sent.repartition(width, "lang", "phrase").mapInArrow(count, "lang string, phrase string, words int, a long")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by their lowest-scoring cut."""
    cut = stored(pieces(docs, lang_col, text_col), "collocation-pieces")
    by_lang = stored(cut.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n")), "collocation-words")
    words = cut.agg(F.sum("words")).head()[0] or 0
    counts = stored(phrase_counts(cut, words, least, longest), "collocation-counts")

    candidates = counts.where("words > 1")
    split = candidates.withColumn("w", F.split("phrase", " "))
    # a phrase of equal count that is one word longer
    told = split.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.expr("slice(w, 1, words - 1)"), " "), F.array_join(F.expr("slice(w, 2, words - 1)"), " "))).alias("phrase"), "a")
    inside = told.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = split.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")

    cuts = free.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    part = lambda words: F.struct("lang", F.array_join(F.expr(words), " ").alias("phrase"))
    cuts = cuts.select("lang", "phrase", "a", "k", part("slice(w, 1, k)").alias("first"), part("slice(w, k + 1, words - k)").alias("rest"))
    known = stored(counts.select(F.struct("lang", "phrase").alias("part"), "a"), "collocation-parts")
    asked = joined(cuts, known.toDF("first", "l"), "first", "inner")
    asked = joined(asked, known.toDF("rest", "r"), "rest", "inner")
    scored = joined(asked, by_lang, "lang", "inner").withColumn("score", F.expr(SCORE))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")

    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    range_ = F.pmod(F.xxhash64("phrase"), F.lit(RANGES))
    near = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang", range_).orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
