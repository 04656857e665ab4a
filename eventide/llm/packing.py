"""Documents packed into training sequences by first-fit decreasing.

A document becomes token ids and a closing id.  Ids are cut into pieces of at most
``length``, which are dealt to random groups; each group is packed on its own by first-fit
decreasing, with a tournament tree over the free room of its bins to find the
first bin that fits in logarithmic time.  Only piece lengths and checksums are
shuffled, never ids.  The pieces are written once, and the number of groups follows
their number, so a group stays near ``group_pieces`` pieces at any size and with texts of any length.

A remainder of more than half a sequence is cut at that half: no other item is then larger than
half a bin, and first-fit decreasing leaves almost no room unused.

Defined cases: a null or empty text is the closing id alone; a null id is carried like any other;
repeated rows are packed like any others, and dealt apart by the task that read them and their place among
its equal rows, so a row that repeats a million times fills no single group; an empty table gives an
empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Words whose ids a worker keeps at most in each of two generations.
CACHE_WORDS = 400_000


class WordIds:
    """Token ids of words without white space, as little-endian 32-bit numbers.

    The tokenizer splits at white space before anything else, so a text's ids are its
    words' ids in a row.  Its added tokens are matched on the raw text: a text that has one when
    lower-cased goes to the tokenizer whole.  When the young generation is full it becomes the old one, and
    words that are met again move back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.markers = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(max(ends, default=0) + 1, bool)  # by id, whether it ends a word
        self.ends[ends] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, data: bytes) -> bytes:
        lower = data.lower()  # the tokenizer lower-cases too
        if any(m in lower for m in self.markers):
            return self.ids([data])[0]
        words = lower.split()
        absent = [w for w in set(words) if w not in self.young]
        if len(self.young) + 2 * len(absent) > CACHE_WORDS:
            self.old, self.young = self.young, {}
            absent = list(set(words))
        if absent:
            self.learn(absent)
        return b"".join(map(self.young.__getitem__, words))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; words of Latin letters alone are encoded as one text, as each has one id that ends a word."""
        texts = [w.decode(errors="replace") for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha() and max(t) < "\u0100"]
        found: list[bytes] = [b""] * len(words)
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in plain])], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(at) == len(plain):
            data, bounds = ids.tobytes(), [0, *(4 * at).tolist()]
            for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
                found[i] = data[a:b]
        else:
            plain = []
        told = set(plain)
        rest = [i for i in range(len(words)) if i not in told]
        for i, x in zip(rest, self.ids([words[i] for i in rest]), strict=True):
            found[i] = x
        return found

    def learn(self, words: list[bytes]) -> None:
        """Adds words to the young generation.

        A letter and a stop or comma after it are apart for the tokenizer, so a word that
        ends in one is its stem's ids and the mark's.
        """
        old, young = self.old, self.young
        stems = {w: w[:-1] for w in words if w[-1:] in (b".", b",") and w[-2:-1].isalpha() and w not in old}
        new = {w for w in {*words, *stems.values(), *(w[-1:] for w in stems)} if w not in young and w not in stems}
        young |= {w: old[w] for w in new if w in old}
        missing = [w for w in new if w not in young]
        if missing:
            young |= zip(missing, self.of_words(missing), strict=True)
        young |= {w: young[stem] + young[w[-1:]] for w, stem in stems.items()}


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """A worker's word table, kept from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, copy): the pieces of all documents.

    ``copy`` names the task that read the row and tells apart its rows with the same id and text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    closing = np.asarray([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, task = word_ids(tokenizer), TaskContext.get().partitionId() << 32
        met: dict[int, int] = {}
        for batch in batches:
            row, start, size, crc, total, copy = [], [], [], [], [], []
            for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = words.encode(text.as_buffer().to_pybytes()) + closing
                n = len(ids) // 4
                same = hash((key, zlib.crc32(ids)))
                met[same] = seen = met.get(same, -1) + 1
                for at, to in cuts(n, length):
                    row.append(i)
                    start.append(at)
                    size.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    total.append(n)
                    copy.append(task + seen)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total, copy))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "copy"])
        words.old = {}  # the worker may go on to other work

    raw = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("data"))
    return raw.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, copy long").withColumnRenamed("id", id_col)


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """Where a document of ``n`` ids is cut: whole sequences, then a remainder, halved if it is over half a sequence."""
    full = n // length * length
    found = [(at, at + length) for at in range(0, full, length)]
    if n - full > length // 2:
        found.append((full, full + length // 2))
        full += length // 2
    return found + ([(full, n)] if full < n else [])


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, of which the largest goes first and each to the first bin with room.

    ``room`` is a tournament tree: a node holds the larger of its children's free room.
    Bins that nothing can enter any more, and those that are yet empty, take part too.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [length] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[item], offsets[item] = at - leaves, length - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 4096, seed: int = 5) -> DataFrame:
    """The pieces of all documents with their sequence and their offset in it."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = stored(pieces(docs, tokenizer, length, closing_id, id_col, text_col).withColumnRenamed(id_col, "id"), "packing-pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "id", "start", "ids_crc32", "copy"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("id", "start", "ids_crc32", "copy")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        sequences = (group["group"][0].as_py() << 40) + bins
        columns = [*(group[c] for c in ("id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
        return pa.table(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    packed = dealt.groupBy("group").applyInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
