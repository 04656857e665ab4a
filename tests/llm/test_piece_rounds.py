"""Piece sampling goes through the rows of a batch side by side, and each row gets what it gets alone."""

import random

import numpy as np
import public_tokenizers
import pytest

from eventide.llm import piece_sampling


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def mixed_texts(n):
    rng = random.Random(2)
    words = "the of naïve 𐍈 a ▁ unbelievable\n x 3.5% internationalisation".split(" ")
    return ["", "a", "\n", "x" * 3000, "word " * 2000] + [" ".join(rng.choices(words, k=rng.randrange(120))) for _ in range(n)]


def outcome(row, pieces):
    return [(row.ids(s, pieces).tolist(), s.log_p, s.value, row.log_inclusion(s)) for s in row.samples]


@pytest.mark.parametrize("k", [1, 2, 7])
def test_rows_get_together_what_they_get_alone(pieces, k):
    texts = mixed_texts(40)
    keys = np.arange(len(texts)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    together = [outcome(row, pieces) for row in piece_sampling.sampled(texts, keys, pieces, k)]
    alone = [outcome(next(piece_sampling.sampled([t], keys[i : i + 1], pieces, k)), pieces) for i, t in enumerate(texts)]
    assert together == alone
    for t, samples in zip(texts, together, strict=True):
        assert [v for _, _, v, _ in samples] == sorted((v for _, _, v, _ in samples), reverse=True)
        assert all(pieces.decode(np.array(ids, np.int32)).decode() == t.replace("▁", " ") == pieces.decode(ids).decode() for ids, *_ in samples)


def test_sets_are_valued_together(pieces, monkeypatch):
    calls, plain = [], piece_sampling.bounded_gumbel
    monkeypatch.setattr(piece_sampling, "bounded_gumbel", lambda *a: calls.append(1) or plain(*a))
    texts = mixed_texts(60)
    assert len(list(piece_sampling.sampled(texts, np.arange(len(texts)).astype(np.uint64), pieces, 2))) == len(texts)
    # two rounds, in each of them the first places and those beyond
    assert len(calls) <= 4
