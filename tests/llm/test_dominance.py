"""Dominance packing: the planner against exhaustive search, the operator against plain tokenizing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventide.llm import dominance_packing as dp

MODEL = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, length):
    """Fewest bins, by trying everything."""
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            k = rooms.index(room)
            go(i + 1, rooms[:k] + [room - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, length - items[i]])

    go(0, [])
    return best[0]


def layout(items, length):
    """The planned bins as lists of (offset, size), checked to be gapless and to hold every item once."""
    runs, used = dp.plan(dict(Counter(items)), length)
    placed, bins = Counter(), {}
    for size, first, n, lo, each, offset in sorted(runs):
        assert first == placed[size]
        placed[size] += n
        for k in range(n):
            bins.setdefault(lo + k // each, []).append((offset + k % each * size, size))
    assert placed == Counter(items) and len(bins) == used
    for held in bins.values():
        held.sort()
        assert [at for at, _ in held] == np.cumsum([0] + [s for _, s in held])[:-1].tolist()
        assert sum(s for _, s in held) <= length
    return bins


def test_fixed_sets_keep_the_fewest_bins():
    rng, more, fixed = random.Random(3), 0, 0
    for _ in range(800):
        length, low = rng.choice([10, 20, 31]), rng.choice([1, 3, 6])
        items = [rng.randint(low, length) for _ in range(rng.randint(0, 9))]
        bins = dp.Bins(dict(Counter(items)), length)
        taken = bins.reduce()
        rest = [s for s, n in bins.left.items() for _ in range(n)]
        assert taken + fewest(rest, length) == fewest(items, length), items
        more += len(layout(items, length)) - fewest(items, length)
        fixed += taken
    assert fixed > 1000 and more <= 2


def test_many_pieces_fill_their_sequences():
    rng = random.Random(4)
    items = [min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    assert len(layout(items, 2048)) <= sum(items) // 2048 + 2
    assert dp.plan({}, 2048) == ([], 0)


def plainly(docs, length):
    tokenizer = Tokenizer.from_file(MODEL)
    found = []
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.asarray(ids[at : at + length], "<u4")
            found.append((key, k, at, len(part), zlib.crc32(part.tobytes())))
    return found


def test_pieces_places_and_odd_rows(odd, none):
    length = 64
    rows = dp.pack(odd, MODEL, length).collect()
    order = lambda x: tuple((v is not None, v) for v in x)
    want = plainly([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], length)
    assert sorted((tuple(r[:5]) for r in rows), key=order) == sorted(want, key=order)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [at for at, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist()
        assert sum(n for _, n in held) <= length
    assert len(bins) <= sum(x[3] for x in want) // length + 2
    assert dp.pack(none, MODEL).collect() == []


def test_copies_of_one_document_and_a_very_long_one(spark):
    same = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("one two three").alias("text"))
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 20_000)], "doc_id int, text string")
    rows = dp.pack(same.unionByName(long), MODEL)
    held = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("places"), F.count("*").alias("rows"))
    assert held.where("n > 2048 or places <> rows").count() == 0
    total = rows.agg(F.sum("length")).head()[0]
    assert held.count() <= total // 2048 + 2
    assert rows.where("doc_id = 7").count() == 3000
