import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventide.llm import bottom_k, packing

BPE = public_tokenizers.path("word_bpe_49k.json")


def shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_small_sets_are_exact(spark):
    pairs = [("a b c d e f g", "a b c d e f h"), ("", ""), (None, "x"), ("x y", "x y"), ("a b c d e", "a b c d e f")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", bottom_k.sketch("a").alias("s"), bottom_k.sketch("b").alias("t"))
    for r in df.select("a", "b", bottom_k.resemblance(F.col("s"), F.col("t")).alias("j"), bottom_k.containment(F.col("s"), F.col("t")).alias("c"), bottom_k.distinct_shingles(F.col("s")).alias("n")).collect():
        a, b = shingles(r["a"]), shingles(r["b"])
        assert r["j"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert r["c"] == pytest.approx(len(a & b) / len(a) if a else 1)
        assert r["n"] == len(a)


def test_estimates_and_merging(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words[2000:] + words[:1000])), (2, "")], "k int, t string").withColumn("s", bottom_k.sketch("t"))
    whole = {r["k"]: r for r in bottom_k.merged_by(df, "k", "s").withColumn("n", bottom_k.distinct_shingles(F.col("s"))).collect()}
    assert whole[2]["s"] == [] and whole[1]["n"] == pytest.approx(3999, rel=0.25)
    assert df.where("k = 1").select(F.sort_array(F.collect_set("k"))).count() == 1
    a, b = (r["s"] for r in df.where("k = 1").collect())
    assert whole[1]["s"] == sorted({*a, *b})[: bottom_k.K]


def test_next_by_descending_id(spark):
    ids = [3, 900, -5, 17, 42, 43, 44, 10_000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, t string")
    got = {r["doc_id"]: r["next_t"] for r in bottom_k.with_next(df, "doc_id", ["t"], ["t"], parts=5).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"t{down[(k + 1) % len(down)]}" for k, i in enumerate(down)}


def test_edited_report(odd, none):
    rows = odd.where("doc_id is not null and doc_id <> 5")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    down = sorted(texts, reverse=True)
    for r in bottom_k.edited_report(rows).collect():
        t, nxt = texts[r["doc_id"]], texts[down[(down.index(r["doc_id"]) + 1) % len(down)]]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if len(shingles(t) | shingles(e)) < bottom_k.K:
            a, b = shingles(t), shingles(e)
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
    assert bottom_k.edited_report(odd).count() == odd.count()
    assert bottom_k.edited_report(none).count() == 0


def whole_ids(text):
    return [*Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids, 1]


def test_words_give_the_texts_ids():
    table = packing.WordIds(BPE)
    for t in ["", "Hello, World. don't STOP", "a.b, c.. d,. É. naïve", "<|startoftext|>x <|endoftext|>", "x\x1cy\x85z 3.14, 5%.", "It's. we'll,", "<|ENDOFTEXT|>", "hi <|StartOfText|> x", "A<|endoftext|>B <|EndOfText|>."]:
        assert np.frombuffer(table.encode(t.encode()), "<u4").tolist() == whole_ids(t)[:-1]
    packing.CACHE_WORDS, kept = 4, packing.CACHE_WORDS
    try:
        assert np.frombuffer(table.encode(b"a b c d e f, g."), "<u4").tolist() == whole_ids("a b c d e f, g.")[:-1]
    finally:
        packing.CACHE_WORDS = kept


def test_first_fit_decreasing_is_the_plain_loop():
    sizes = np.random.default_rng(0).integers(1, 2049, 500)
    bins, offsets = packing.first_fit_decreasing(sizes, 2048)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [2048] if b == len(room) else []
        want[i] = (b, 2048 - room[b])
        room[b] -= sizes[i]
    assert {i: (bins[i], offsets[i]) for i in range(500)} == want


def test_pack(odd, none):
    got = packing.pack(odd, BPE).toPandas()
    texts = [(r["doc_id"], whole_ids(r["text"])) for r in odd.collect()]
    assert got["length"].sum() == sum(len(x) for _, x in texts)
    for seq in got.groupby("sequence_id"):
        s = seq[1].sort_values("offset")
        assert (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum()[:-1]])).all() and s["length"].sum() <= 2048
    for i, ids in texts:
        if i is None or i == 5:
            continue
        p = got[got["doc_id"] == i].sort_values("start")
        assert p["start"].iloc[0] == 0 and p["length"].sum() == len(ids) == p["doc_tokens"].iloc[0]
        for s, n, c in p[["start", "length", "ids_crc32"]].itertuples(index=False):
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c
    assert packing.pack(none, BPE).count() == 0


def test_pack_keeps_large_and_null_ids_and_deals_copies_apart(spark):
    rows = [((1 << 60) + 1, "one two"), ((1 << 60) + 3, "one two"), (None, "one two"), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    same = spark.createDataFrame([(7, "again and again")] * 600, "doc_id long, text string")
    got = packing.pack(same, BPE, group_pieces=50).toPandas()
    sizes = got.groupby(got["sequence_id"] // (1 << 40)).size()
    assert len(got) == 600 and len(sizes) > 8 and sizes.max() < 120


def test_ids_of_text_are_ordered_as_text(spark):
    rows = [("b", "one two three four five six seven"), ("a", "six seven eight nine ten eleven"), (None, "twelve words or fewer are here now"), ("c", None), ("b", "a second row of the same id here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = bottom_k.edited_report(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["None", "a", "b", "b", "c"]
    by = {r["doc_id"]: r for r in got}
    # after c comes one of b's rows, after a the row without id, after that c again
    half = len(rows[1][1]) // 2
    assert by["a"]["edited_sha256"] == hashlib.sha256((rows[1][1][: len(rows[1][1]) - half] + rows[2][1][:half]).encode()).hexdigest()
    assert by["c"]["n_chars"] == 0
