"""Documents packed into as few sequences as possible: dominance reduction, then best fit.

A document becomes token ids and a closing id; only documents longer than a sequence are cut.  What has to be packed is
then a count for each length from 1 to ``length``, however many documents there are.  On these counts
(``plan``, at most ``length`` rows) pairs and triples that provably dominate every other way to fill a sequence are fixed for good and
taken out, the instance shrinks, and what is left goes by best fit, longest first.  Equal pieces are placed together, as
runs: so many pieces of one length, so many to a sequence, from one sequence on.  The number of runs follows ``length``, not the data.

Spark does the rest: it cuts and counts, gives each piece its rank among the pieces of its length (by the counts of the
tasks before its own), and each rank finds its run by binary search.  Only lengths and checksums are shuffled, and
the key of a join is (task, length), so copies of one document never meet in one task.

Defined cases: a null or empty text is the closing id alone; a null id is carried like any other; repeated rows are
packed like any others; an empty table gives an empty result; other columns are not read; a text of any length is cut
in the task that reads it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .packing import word_ids

#: size, rank of the first piece, pieces, first sequence, pieces to a sequence, place of the first piece there
Run = tuple[int, int, int, int, int, int]


class Bins:
    """Sequences that are being filled, and the runs that say with what."""

    def __init__(self, counts: dict[int, int], length: int):
        self.length = length
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.next_rank: defaultdict[int, int] = defaultdict(int)
        self.used = 0
        self.runs: list[Run] = []

    def put(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        """``n`` pieces of a size go to the sequences from ``first`` on, ``each`` to a sequence."""
        self.runs.append((size, self.next_rank[size], n, first, each, offset))
        self.next_rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)

    def fix(self, sizes: list[int]) -> None:
        """Fixes the set of sizes as often as the pieces left allow."""
        times = min(self.left[s] // sizes.count(s) for s in set(sizes))
        offset = 0
        for s in dict.fromkeys(sizes):
            each = sizes.count(s)
            self.put(s, times * each, self.used, each, offset)
            offset += s * each
        self.used += times

    def smallest(self, besides: int, above: int, n: int) -> list[int]:
        """The ``n`` smallest pieces of a size over ``above``, one piece of size ``besides`` left out."""
        found: list[int] = []
        for s in self.sizes[bisect_left(self.sizes, above + 1) :]:
            found += [s] * min(n - len(found), self.left[s] - (s == besides))
            if len(found) >= n:
                break
        return found

    def largest(self, besides: int, room: int) -> int:
        """The size of the largest piece that fits, one piece of size ``besides`` left out; 0 if there is none."""
        at = bisect_left(self.sizes, room + 1) - 1
        while at >= 0 and self.left[self.sizes[at]] == (self.sizes[at] == besides):
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def best_pair(self, besides: int, room: int) -> tuple[int, int]:
        """The two pieces of the largest sum that fits, the larger first; of equal sums that with the largest piece."""
        there = [s for s in self.sizes if self.left[s] > (s == besides)]
        best, lo = (0, 0), 0
        for hi in range(len(there) - 1, -1, -1):
            while lo + 1 < len(there) and there[lo + 1] + there[hi] <= room:
                lo += 1
            at = min(lo, hi)
            if at == hi and self.left[there[hi]] - (there[hi] == besides) < 2:
                at -= 1
            if at >= 0 and there[at] + there[hi] <= room and there[at] + there[hi] > sum(best):
                best = (there[hi], there[at])
        return best

    def dominating(self, s: int) -> list[int]:
        """A set with the size ``s`` that dominates every other set that holds a piece of it, or nothing.

        A set dominates another if its pieces can be exchanged for those of the other, each for one or more that are together no larger.
        """
        room = self.length - s
        fit = self.largest(s, room)
        if not fit:
            return [s]
        few = self.smallest(s, 0, 3)
        # beside s there is room for one piece at most: none is better than the largest
        if s + fit == self.length or len(few) < 2 or few[0] + few[1] > room:
            return [s, fit]
        if len(few) == 3 and sum(few) <= room:
            return []
        # for two at most
        a, b = self.best_pair(s, room)
        if fit >= a + b:
            return [s, fit]
        between = self.smallest(s, b, 2)
        if a == fit and (len(between) < 2 or sum(between) > room):  # so of any two that fit one is no larger than b, the other no larger than a
            return [s, a, b]
        return []

    def reduce(self) -> int:
        """Fixes dominating sets, largest pieces first, until none is found; the number of sequences that this fills."""
        before, again = self.used, True
        while again:
            again = False
            for s in self.sizes[::-1]:
                while s in self.left and (found := self.dominating(s)):
                    self.fix(found)
                    again = True
        return self.used - before

    def best_fit(self) -> None:
        """What is left, largest first, each piece to the sequence with the least room that takes it."""
        rooms: list[int] = []  # sorted; of each the sequences that have so much room, as ranges
        ranges: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, lo: int, hi: int) -> None:
            if room and lo < hi:
                if room not in ranges:
                    ranges[room] = []
                    insort(rooms, room)
                ranges[room].append((lo, hi))

        def fill(s: int, room: int, lo: int, hi: int) -> None:
            """Fills sequences of one room with pieces of size ``s``: what has taken one has the least room then, so it goes on."""
            each = room // s
            full = min(hi - lo, self.left[s] // each)
            if full:
                self.put(s, full * each, lo, each, self.length - room)
                keep(room - each * s, lo, lo + full)
            rest = self.left.get(s, 0)
            if rest and lo + full < hi:
                self.put(s, rest, lo + full, rest, self.length - room)
                keep(room - rest * s, lo + full, lo + full + 1)
                full += 1
            keep(room, lo + full, hi)

        for s in self.sizes[::-1]:
            while s in self.left and (at := bisect_left(rooms, s)) < len(rooms):
                room = rooms.pop(at)
                for lo, hi in ranges.pop(room):
                    if s in self.left:
                        fill(s, room, lo, hi)
                    else:
                        keep(room, lo, hi)
            if s in self.left:
                more = -(-self.left[s] // (self.length // s))
                self.used += more
                fill(s, self.length, self.used - more, self.used)


def plan(counts: dict[int, int], length: int) -> tuple[list[Run], int]:
    """(runs, sequences) for so many pieces of each size."""
    bins = Bins(counts, length)
    bins.reduce()
    bins.best_fit()
    return bins.runs, bins.used


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, rank): documents cut at whole sequences.

    ``rank`` counts the pieces of one length that one task cuts, from 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    closing = np.asarray([closing_id], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, task = word_ids(tokenizer), TaskContext.get().partitionId()
        met = [0] * (length + 1)
        for batch in batches:
            row, piece, size, crc, rank = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_buffer().to_pybytes()) + closing
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(k)
                    size.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(met[n])
                    met[n] += 1
            start = [k * length for k in piece]
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc, [task] * len(row), rank))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        words.old = {}  # the worker may go on to other work

    raw = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("data"))
    return raw.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): all pieces with their places."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = stored(pieces(docs, tokenizer, length, closing_id, id_col, text_col), "dominance-pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``length`` rows, whatever the table holds
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.asarray(sorted(plan(counts, length)[0]), np.int64).reshape(-1, 6)

    # a row for each task that has the length
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {int(s): runs[runs[:, 0] == s] for s in np.unique(runs[:, 0])}
        for batch in batches:
            sizes, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == s)
                _, first, _, bins, each, at = by_size[s][np.searchsorted(by_size[s][:, 1], ranks[mine], side="right") - 1].T
                k = ranks[mine] - first
                sequence[mine], offset[mine] = bins + k // each, at + k % each * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
