"""Word n-gram scores by deleted interpolation.

P(w | u) = m_b * c(u w) / c(u) + (1 - m_b) * P1(w): a maximum-likelihood bigram mixed with
the unigram estimate P1, which adds a half to all counts so that every text has a
probability.  The bucket ``b`` is the logarithm of c(u), the context's frequency; a
context that was never seen leaves P1 alone.  The weights ``m_b`` are learned by
expectation-maximisation: counts of the fitting part (training rows but a fifth of all rows)
predict the tokens of the rest of the training rows, which they have not seen.  The final counts take in both.

The work is dealt in blocks of documents:

1. Documents are gathered into blocks of about ``BLOCK_BYTES``, each of one part (fit, mix or
   held out), and written once to the shared folder.
2. Each block counts its own n-grams and asks for their corpus counts: one request to every
   range of the hashes of words and word pairs, with sorted hashes and counts.
3. Each range adds up the counts that all blocks report and answers every request.  A common
   n-gram is one entry per block, so no range is skewed, and the memory of a range
   is bounded, as their number follows the size of the corpus.
4. Mix blocks join their answers and are reduced to histograms of how much better the
   higher order predicts; the weights come from these.
5. All blocks join their answers and score their documents.

Words are known by their bytes, so their counts, ``n_known`` and ``base_score`` are exact.  A word pair is known by a
64-bit hash; two of n pairs share one with a probability of about n * n / 2**65 (one in 40 for a billion).

A block asks a range only if it has an n-gram of it, so requests never outnumber a block's n-grams; while ranges
are larger than that, there are as many as blocks times ranges.

Defined cases: a null text counts as empty, which is the end token alone; rows that repeat
an id are counted and scored each; a null id is hashed as the text ''; without training
rows every token has the probability of the empty unigram table (1); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored, text_or_empty

BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
FIT, MIX, HELD = 0, 1, 2
#: Steps of the natural logarithm in the histograms that the weights are learned from.
STEP = 1 / 64
END, START = xxhash.xxh64_intdigest(b"\x00end", 6), xxhash.xxh64_intdigest(b"\x00start", 6)


# --- hashes and packed arrays ----------------------------------------------------------


class Words(dict):
    """Word -> its number in a block; a new word is hashed once.  Number 0 is the end token, as the empty word."""

    def __init__(self) -> None:
        super().__init__()
        self[b""] = 0
        self.hashes = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, 6))
        return at


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: their gaps by planes of bytes, of which the upper ones are nearly all zero."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return packed(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return packed(counts.astype("<i8").tobytes())


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(unpacked(data), "<i8")


@dataclass
class Grams:
    """The words and word pairs of a block in order of their hashes, their counts, and which of them each token is."""

    names: list[bytes]
    words: np.ndarray
    word_counts: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    pair: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def contexts(self, counts: np.ndarray, docs: int) -> np.ndarray:
        """The count of each token's context: the word before it, or the start of a document."""
        found = np.roll(counts[self.word], 1)
        found[self.first] = docs
        return found


def grams(texts: list[bytes]) -> Grams:
    """Words (A-Z lower-cased, without ASCII white space) and an end token for each text."""
    number = Words()
    rows = [np.fromiter(map(number.__getitem__, t.lower().split()), np.int64) for t in texts]
    sizes = np.array([len(r) + 1 for r in rows], np.int64)
    ends = np.cumsum(sizes)
    flat = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    flat[inner] = np.concatenate(rows)
    hashes = np.array(number.hashes, np.uint64)
    order = np.argsort(hashes, kind="stable")
    table, known = hashes[order], list(number)
    by = np.empty(len(order), np.int64)
    by[order] = np.arange(len(order))
    word = by[flat]
    first = ends - sizes
    before = np.roll(table[word], 1)
    before[first] = np.uint64(START)
    pairs, pair, pair_counts = np.unique(pair_hash(before, table[word]), return_inverse=True, return_counts=True)
    return Grams([known[i] for i in order.tolist()], table, np.bincount(word, minlength=len(table)), word, pairs, pair_counts, pair, first, np.repeat(np.arange(len(texts)), sizes))


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of 64-bit hashes begins in sorted keys, and the end."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


# --- the jobs --------------------------------------------------------------------------


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, part, n_docs, n_bytes, ids, sizes, data): documents of one part with their texts compressed, written once."""
    kind = docs.schema[id_col].dataType.simpleString()
    remainder = fold(F.col(id_col), 5)
    part = F.when(remainder == 1, HELD).when(remainder == 0, MIX).otherwise(FIT).alias("part")
    raw = docs.select(F.col(id_col).alias("id"), part, text_or_empty(text_col).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {p: ([], []) for p in (FIT, MIX, HELD)}
        size = dict.fromkeys(held, 0)

        def row(p: int) -> pa.RecordBatch:
            nonlocal made
            ids, texts = held[p]
            data = b"".join(texts)
            columns = [pa.array([(task << 32) + made], pa.int64()), pa.array([p], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())]
            held[p], size[p], made = ([], []), 0, made + 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "part", "n_docs", "n_bytes", "ids", "sizes", "data"])

        for batch in batches:
            id_type = batch.schema.types[0]
            for i, p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = data.as_buffer().to_pybytes()
                held[p][0].append(i)
                held[p][1].append(text)
                size[p] += len(text)
                if size[p] >= BLOCK_BYTES:
                    yield row(p)
        for p in held:
            if held[p][0]:
                yield row(p)

    return stored(raw.mapInArrow(run, f"block long, part int, n_docs long, n_bytes long, ids array<{kind}>, sizes array<long>, data binary"), "lm-blocks")


def block_texts(n_bytes: int, sizes: list[int], data: bytes) -> list[bytes]:
    whole = pa.decompress(data, n_bytes, "zstd", asbytes=True) if n_bytes else b""
    return [whole[e - s : e] for s, e in zip(sizes, np.cumsum(sizes).tolist(), strict=True)]


def answers(table: DataFrame, word_ranges: int, pair_ranges: int) -> DataFrame:
    """(block, range, counts, fitted): for each request the counts in the training rows, in the request's order.

    Ranges of words come before those of pairs.  ``fitted`` has the counts of the fitting part, for mix
    blocks.  Each range of words adds a row with block -1: the number of tokens
    and of distinct words, of the training rows and of the fitting part.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, n_bytes, sizes, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                g = grams(block_texts(n_bytes, sizes, data))
                rows = []
                spelled = lambda a, b, g=g: packed(b" ".join(g.names[a:b]))
                hashed = lambda a, b, g=g: packed_keys(g.pairs[a:b])
                for base, ranges, keys, counts, form in ((0, word_ranges, g.words, g.word_counts, spelled), (word_ranges, pair_ranges, g.pairs, g.pair_counts, hashed)):
                    cuts = range_cuts(keys, ranges).tolist()
                    rows += [(base + r, block, part, form(a, b), packed_counts(counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_pylist([dict(zip(REQUEST.names, r, strict=True)) for r in rows], schema=REQUEST)

    def answer(asked: pa.Table) -> pa.Table:
        r = asked["range"][0].as_py()
        asked = asked.sort_by("block")
        block, part = asked["block"].to_pylist(), asked["part"].to_pylist()
        sent = (k.as_buffer().to_pybytes() for k in asked["keys"])
        counts = [unpacked_counts(c.as_buffer().to_pybytes()) for c in asked["counts"]]
        if r < word_ranges:
            number = Numbers()
            at = [np.fromiter(map(number.__getitem__, unpacked(k).split(b" ")), np.int64) for k in sent]
            n = len(number)
        else:
            keys = [unpacked_keys(k) for k in sent]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            at, n = np.split(at, np.cumsum([len(k) for k in keys])[:-1]), len(distinct)
        fit, mix = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for p, c, i in zip(part, counts, at, strict=True):
            if p != HELD:
                (fit if p == FIT else mix)[i] += c  # a block asks for a key once
        both = fit + mix
        rows = [(b, r, packed_counts(both[i]), packed_counts(fit[i]) if p == MIX else None) for b, p, i in zip(block, part, at, strict=True)]
        if r < word_ranges:
            rows.append((-1, r, packed_counts(np.array([both.sum(), (both > 0).sum(), fit.sum(), (fit > 0).sum()])), None))
        return pa.Table.from_pylist([dict(zip(ANSWER.names, x, strict=True)) for x in rows], schema=ANSWER)

    asked = table.select("block", "part", "n_bytes", "sizes", "data").mapInArrow(ask, "range int, block long, part int, keys binary, counts binary")
    return stored(asked.groupBy("range").applyInArrow(answer, "block long, range int, counts binary, fitted binary"), "lm-answers")


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


REQUEST = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("counts", pa.binary()), ("fitted", pa.binary())])


@dataclass
class Corpus:
    """Tokens, distinct words and documents that counts were taken from."""

    tokens: int
    words: int
    docs: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))


def block_counts(answered: pa.Table, column: str, word_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The corpus counts of a block's words and pairs."""
    answered = answered.sort_by("range")
    found = [unpacked_counts(c.as_buffer().to_pybytes()) for c in answered[column]]
    n = sum(r < word_ranges for r in answered["range"].to_pylist())
    return np.concatenate(found[:n]), np.concatenate(found[n:])


def bucket(contexts: np.ndarray) -> np.ndarray:
    """The bucket of a context's count, which must be over 0."""
    return np.floor(np.log2(np.maximum(contexts, 1))).astype(np.int64)


def learned_weights(histogram: list[tuple[int, int | None, int]], rounds: int = 100) -> np.ndarray:
    """The bigram's weight for each of 64 buckets, from (bucket, step of log ratio or None, tokens).

    A step is the logarithm of bigram over unigram probability in units of ``STEP``; None
    stands for a bigram that was not seen.  A bucket without data takes the weight of the nearest one, the
    lower of equals.
    """
    weights = np.full(64, np.nan)
    for b in {h[0] for h in histogram}:
        rows = [h for h in histogram if h[0] == b]
        ratio = np.array([0.0 if s is None else np.exp(s * STEP) for _, s, _ in rows])
        n = np.array([c for _, _, c in rows], float)
        m = 0.5
        for _ in range(rounds):
            m = float((n * (m * ratio / (m * ratio + 1 - m))).sum() / n.sum())
        weights[b] = min(m, 1 - 1e-6)
    known = np.flatnonzero(~np.isnan(weights))
    if not len(known):
        return np.full(64, 0.5)
    return np.array([weights[min(known, key=lambda k: (abs(k - b), k))] for b in range(64)])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = blocks(docs, id_col, text_col)
    sums = {r["part"]: r for r in table.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum("n_bytes").alias("bytes")).collect()}
    total_bytes = sum(r["bytes"] for r in sums.values())
    n_docs = {p: sums[p]["docs"] if p in sums else 0 for p in (FIT, MIX, HELD)}
    pair_ranges = max(1, -(-total_bytes // RANGE_BYTES))
    word_ranges = max(1, pair_ranges // 4)
    answered = answers(table, word_ranges, pair_ranges)
    totals = answered.where("block = -1").select("counts").collect()
    tokens, words, fit_tokens, fit_words = (int(x) for x in sum((unpacked_counts(r["counts"]) for r in totals), np.zeros(4, np.int64)))
    whole, fitted = Corpus(tokens, words, n_docs[FIT] + n_docs[MIX]), Corpus(fit_tokens, fit_words, n_docs[FIT])

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for n_bytes, sizes, data in zip(*(left[c].to_pylist() for c in ("n_bytes", "sizes", "data")), strict=True):
            g = grams(block_texts(n_bytes, sizes, data))
            of_word, of_pair = block_counts(right, "fitted", word_ranges)
            contexts, seen = g.contexts(of_word, fitted.docs), of_pair[g.pair]
            used = contexts > 0
            contexts, seen, single = contexts[used], seen[used], fitted.unigram(of_word[g.word[used]])
            step = np.where(seen > 0, np.round(np.log(np.maximum(seen, 1) / contexts / single) / STEP), -(1 << 20)).astype(np.int64)
            keys, n = np.unique(np.stack([bucket(contexts), step]), axis=1, return_counts=True)
            out.append(pa.table({"bucket": keys[0], "step": keys[1], "n": n.astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "step", "n")})

    mix = table.where(F.col("part") == MIX).select("block", "n_bytes", "sizes", "data")
    replies = answered.where("block >= 0")
    found = mix.groupBy("block").cogroup(replies.where("fitted is not null").select("block", "range", "fitted").groupBy("block")).applyInArrow(histogram, "bucket long, step long, n long")
    rows = found.groupBy("bucket", "step").agg(F.sum("n").alias("n")).collect()
    weights = learned_weights([(r["bucket"], None if r["step"] == -(1 << 20) else r["step"], r["n"]) for r in rows])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for part, n_bytes, ids, sizes, data in zip(left["part"].to_pylist(), left["n_bytes"].to_pylist(), left["ids"], left["sizes"].to_pylist(), left["data"].to_pylist(), strict=True):
            g = grams(block_texts(n_bytes, sizes, data))
            of_word, of_pair = block_counts(right, "counts", word_ranges)
            single = whole.unigram(of_word)[g.word]
            contexts = g.contexts(of_word, whole.docs)
            m = np.where(contexts > 0, weights[bucket(contexts)], 0.0)
            p = (1 - m) * single + m * of_pair[g.pair] / np.maximum(contexts, 1)
            n = len(sizes)
            per_doc = lambda x: np.bincount(g.doc, x, n)  # noqa: B023, E731
            out.append(pa.table({"id": ids.values, "held_out": np.full(n, part == HELD), "n_tokens": np.bincount(g.doc, minlength=n), "n_known": per_doc(of_word[g.word] > 0).astype(np.int64), "train_tokens": np.full(n, whole.tokens), "base_score": per_doc(np.log10(single)), "score": per_doc(np.log10(p))}))
        return pa.concat_tables(out) if out else None

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = table.groupBy("block").cogroup(replies.select("block", "range", "counts").groupBy("block")).applyInArrow(score, schema)
    return scored.withColumnRenamed("id", id_col)
