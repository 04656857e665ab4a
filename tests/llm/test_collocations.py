"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from eventide.llm import collocations as co


def plainly(rows, least, longest=5, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], n[lang], score))
        found += [(lang, i + 1, *x[3:]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(found)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(None, *r, "clash") for r in rows], "doc_id long, lang string, text string, piece string").repartition(5)
    return sorted(tuple(r) for r in co.collocations(docs, **more).collect())


@pytest.mark.parametrize("least", [1, 3, 12])
def test_all_phrases(spark, least):
    rng = random.Random(least)
    words = ["a", "b", "ab", "é", "Zeit", "x y", "𐍈", "c-d"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), text()) for _ in range(120)]
    rows += [("en", "the same line again and again.")] * 80 + [("en", None), (None, None), ("de", " \t.\n"), ("de", "solo")]
    assert mined(spark, rows, least=least) == plainly(rows, least)
    assert mined(spark, rows, least=least, top=3, longest=3) == plainly(rows, least, 3, 3)


def test_a_third_of_the_rows_alike_and_a_long_text(spark):
    rows = [("en", "hot words stand here, and hot words stand there")] * 700 + [("en", f"w{i} w{i + 1} w{i % 7}") for i in range(1400)] + [("en", "on and on " * 12_000)]
    assert mined(spark, rows, least=100) == plainly(rows, 100)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "MAP_BITS", 16)
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{int(rng.expovariate(0.004))}" for _ in range(200))) for _ in range(120)]
    assert mined(spark, rows, least=2) == plainly(rows, 2)


def test_products_beyond_64_bits(spark):
    rows = [(9_876_543_210_123, 99_999_999_999_999_999, 9_999_999_999_999, 99_999_999_999_999), (10**13, 10**16, 10**13, 10**13), (7, 10**15 + 1, 7, 7)]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr(co.SCORE).collect()
    assert [x[0] for x in found] == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", "few words")]) == []
