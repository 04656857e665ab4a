import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from eventide.llm import deleted_interpolation, license_scan, piece_sampling

SP = public_tokenizers.path("piece_bpe_32k.model")


def longest_increasing(values):
    return max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)


def test_increasing():
    rng = random.Random(1)
    for _ in range(60):
        v = [rng.randrange(8) for _ in range(rng.randrange(9))]
        at = license_scan.increasing(v)
        assert at == sorted(at) and all(v[a] < v[b] for a, b in zip(at, at[1:], strict=False)) and len(at) == longest_increasing(v)


def test_patience():
    assert license_scan.patience(list("abcde"), list("abcde")) == [(i, i) for i in range(5)]
    assert license_scan.patience(list("xxabyyc"), list("abc")) == [(2, 0), (3, 1), (6, 2)]
    assert license_scan.patience([], list("a")) == []
    rng = random.Random(2)
    for _ in range(100):
        a, b = [rng.choices("abcdef", k=rng.randrange(12)) for _ in range(2)]
        m = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))


def test_licenses(spark, odd, none):
    filler = " ".join(f"word{i} the and under license" for i in range(400))
    mit = license_scan.TEMPLATES["MIT-text"]
    texts = [f"{filler}\nReleased under the MIT License.\n{filler}", f"{mit} {filler} {mit}", mit.replace("free of charge", "for a fee").upper(), filler, "released under a license", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["MIT", "MIT-text", "MIT-text", None, None, "CC-BY-NC-4.0"]
    assert [x["license"] for x in got[5]["notices"]] == ["CC-BY-NC-4.0", "MIT"] and got[1]["coverage"] == 1.0
    words = license_scan.words(texts[0].encode())
    assert words[got[0]["first_word"] : got[0]["end_word"]] == [b"released", b"under", b"the", b"mit", b"license"]
    assert license_scan.license_scan(odd).count() == odd.count() and license_scan.license_scan(none).count() == 0


def test_look_alike_licenses():
    known = [license_scan.Template(k, v, license_scan.IDENTITY.get(k, ())) for k, v in license_scan.TEMPLATES.items()]
    vocabulary = {w for t in known for w in t.counts}
    names = lambda text: [x[0] for x in license_scan.scan(text.encode(), known, vocabulary)]
    for name, text in license_scan.TEMPLATES.items():
        assert license_scan.scan(text.encode(), known, vocabulary)[0][:2] == (name, 1.0) or name == "Apache-2.0-header", name
        assert name in names(f"the software {text} the license version"), name
    bsd, third, end, mit, mit_end = license_scan._BSD, license_scan._BSD_THIRD, license_scan._BSD_END, license_scan._MIT, license_scan._MIT_END
    want = {
        "Released under the BSD License.": [],
        "Released under the Modified MIT License.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under the Apache License 2.0.": ["Apache-2.0"],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0-short"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-short"],
        "Licensed under CC BY NC 4.0.": [],
        "Licensed under CC BY-NC 3.0.": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0-full"],
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License (GPL), version 3.0.": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License, version 1.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License v3.": ["AGPL-3.0"],
        "Released under the MIT License. Released under the MIT License.": ["MIT", "MIT"],
        bsd: ["BSD-family"],
        f"{bsd} {end}": ["BSD-2-Clause"],
        f"{bsd} * {third} {end}": ["BSD-3-Clause"],
        f"{bsd} 3. {third} {end}": ["BSD-3-Clause"],
        f"{bsd} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement. 4. {third} {end}": ["BSD-family"],
        mit: ["MIT-permission"],
        f"{mit} {mit_end}": ["MIT-text"],
        f"{mit} The Software shall be used for Good, not Evil. {mit_end}": ["MIT-permission"],
        f"{mit} {mit_end} {license_scan._X11_END}": ["X11"],
        f"{mit} {mit_end} and {mit} {mit_end}": ["MIT-text", "MIT-text"],
    }
    assert {t: names(t) for t in want} == want


def all_segmentations(text, pieces):
    """{ids: probability} by listing every path."""
    mark = piece_sampling.MARK
    s = mark + text.replace(" ", mark)
    inv = {pieces.raw[i].decode("utf8", "ignore").replace(" ", mark): i for i in range(pieces.bytes_at + 256, len(pieces.raw)) if pieces.log_weight[i] > pieces.log_weight[pieces.bytes_at] + 1e-9}
    out = {}

    def walk(at, ids, weight):
        if at == len(s):
            out[tuple(ids)] = weight
            return
        for n in range(1, min(16, len(s) - at) + 1):
            if s[at : at + n] in inv:
                i = inv[s[at : at + n]]
                walk(at + n, [*ids, i], weight + pieces.log_weight[i])
        if s[at] not in inv:
            spelled = [x + pieces.bytes_at for x in s[at].encode()]
            walk(at + 1, ids + spelled, weight + len(spelled) * pieces.log_weight[pieces.bytes_at])

    walk(0, [], 0.0)
    top = max(out.values())
    total = sum(math.exp(w - top) for w in out.values())
    return {k: math.exp(w - top) / total for k, w in out.items()}


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(SP)


@pytest.mark.parametrize("text", ["the of", "a b", "x𐍈y"])
def test_samples_follow_the_distribution(pieces, text):
    want, n = all_segmentations(text, pieces), 4000
    keys = np.array([xxhash.xxh64_intdigest(str(i).encode(), 3) for i in range(n)], np.uint64)
    first, both, mean = Counter(), Counter(), Counter()
    for row in piece_sampling.sampled([text] * n, keys, pieces, 2):
        ids = [tuple(row.ids(s, pieces).tolist()) for s in row.samples]
        assert len(set(ids)) == len(ids) == min(2, len(want))
        assert [s.value for s in row.samples] == sorted((s.value for s in row.samples), reverse=True)
        first[ids[0]] += 1
        both[tuple(ids)] += 1
        for s, i in zip(row.samples, ids, strict=True):
            assert math.exp(s.log_p) == pytest.approx(want[i], rel=1e-6)
            mean[i] += want[i] / math.exp(row.log_inclusion(s)) / n
    assert all(abs(first[i] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3 for i, p in want.items())
    # the second sample is drawn from what is left
    for (a, b), c in both.items() if len(want) > 1 else []:
        p = want[a] * want[b] / (1 - want[a])
        assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert sum(mean.values()) == pytest.approx(1, abs=0.05)


def test_all_segmentations_of_a_short_text(pieces):
    want = all_segmentations("to a", pieces)
    row = next(piece_sampling.sampled(["to a"], np.array([7], np.uint64), pieces, 100))
    assert {tuple(row.ids(s, pieces).tolist()) for s in row.samples} == set(want)
    assert row.log_inclusion(row.samples[0]) == 0.0


def test_sampling_table(odd, none):
    got = piece_sampling.sample_segmentations(odd, SP).toPandas()
    assert got["round_trip"].all()
    assert (got[got["doc_id"] == 1]["n_pieces"] == 0).all() and (got["log_inclusion"] <= 0).all()
    again = piece_sampling.sample_segmentations(odd.repartition(7), SP).toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "sample", "ids_crc32", "perturbed"]].to_numpy().tolist()))
    assert key(got) == key(again)
    one = got[got["doc_id"] == 9].iloc[0]
    assert one["ids_crc32"] == zlib.crc32(np.array(one["ids"], "<u4").tobytes())
    assert piece_sampling.sample_segmentations(none, SP).count() == 0


def model_score(texts, parts, weights):
    """(base, score) of each text by plain counting."""
    rows = [[*(t or "").encode().lower().split(), "end"] for t in texts]
    train = [r for r, p in zip(rows, parts, strict=True) if p != 1]
    c = Counter(w for r in train for w in r)
    pair = Counter(x for r in train for x in zip(["start", *r], r, strict=False))
    n, v = sum(c.values()), len(c)
    for r in rows:
        base = [(c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in r]
        total = 0.0
        for u, w, p1 in zip(["start", *r], r, base, strict=False):
            cu = len(train) if u == "start" else c[u]
            m = weights[int(math.log2(cu))] if cu else 0.0
            total += math.log10((1 - m) * p1 + (m * pair[u, w] / cu if cu else 0.0))
        yield len(r), sum(c[w] > 0 for w in r), n, sum(map(math.log10, base)), total


def test_deleted_interpolation(spark, odd, none, monkeypatch):
    monkeypatch.setattr(deleted_interpolation, "BLOCK_BYTES", 400)
    monkeypatch.setattr(deleted_interpolation, "RANGE_BYTES", 500)
    learned = {}
    real = deleted_interpolation.learned_weights
    monkeypatch.setattr(deleted_interpolation, "learned_weights", lambda h: learned.setdefault("w", real(h)))
    rng = random.Random(3)
    texts = [" ".join(rng.choices("the cat sat on a mat And ran".split(), k=rng.randrange(30))) for _ in range(150)] + [None, "", "new words only"]
    got = {r["doc_id"]: r for r in deleted_interpolation.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    parts = [zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))]
    for i, (n, known, total, base, score) in enumerate(model_score(texts, parts, learned["w"])):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (parts[i] == 1, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    assert deleted_interpolation.lm_scores(odd).count() == odd.count()
    assert deleted_interpolation.lm_scores(none).count() == 0


def test_weights_are_the_likelihood_maximum():
    rng = np.random.default_rng(4)
    hist = [(3, int(s), int(n)) for s, n in zip(rng.integers(-100, 200, 40), rng.integers(1, 50, 40), strict=True)] + [(3, None, 100)]
    m = deleted_interpolation.learned_weights(hist)[3]
    loss = lambda x: -sum(n * math.log(x * (0 if s is None else math.exp(s * deleted_interpolation.STEP)) + 1 - x) for _, s, n in hist)
    assert loss(m) <= min(loss(x) for x in np.linspace(0.001, 0.999, 999)) + 1e-3


def test_every_stretch_in_reach_is_aligned():
    template = license_scan.Template("MIT", license_scan.TEMPLATES["MIT"], license_scan.IDENTITY["MIT"])
    rng = random.Random(9)
    vocabulary = [*template.words, b"x"]
    need = 0.8 * len(template.words)
    seen = 0
    for _ in range(3000):
        text = rng.choices(vocabulary, k=rng.randrange(4, 18))
        want = False
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + template.reach) + 1):
                matches = license_scan.patience(text[i:j], template.words)
                want = want or (len(matches) >= need and template.named(text[i:j], matches))
        at = {}
        for i, w in enumerate(text):
            at.setdefault(w, []).append(i)
        assert bool(template.found(text, at, 0.8)) == want, text
        seen += want
    assert seen > 100


def altered(rng, template):
    """The template's words with some left out, put in or replaced, among words of its own."""
    words = list(template.words)
    for _ in range(rng.randint(0, int(0.3 * len(words)))):
        k, op = rng.randrange(len(words)), rng.random()
        words[k : k + (op < 0.7)] = [] if op < 0.4 else [rng.choice([b"foreign", rng.choice(template.words)])]
    around = lambda: [rng.choice([rng.choice(template.words), b"x"]) for _ in range(rng.randint(0, 12))]
    return around() + words + around()


def test_the_best_stretch_of_long_templates_is_found():
    """No stretch of a text in reach, of all there are, covers more than the one that is reported."""
    rng, seen = random.Random(5), 0
    known = [license_scan.Template(k, v, license_scan.IDENTITY.get(k, ())) for k, v in license_scan.TEMPLATES.items()]
    for trial in range(60):
        t = rng.choice([t for t in known if 16 < len(t.words) < 140])
        text, at, need = altered(rng, t), {}, 0.8 * len(t.words)
        for i, w in enumerate(text):
            at.setdefault(w, []).append(i)
        got = t.found(text, at, 0.8)
        places = [i for i, w in enumerate(text) if w in t.counts]
        best = max((t.align(text, i, j + 1, need)[0] for i in places for j in places if need <= j + 1 - i <= t.reach), default=0)
        assert round(got[0][0] * len(t.words)) == best if got else best == 0, (trial, t.name)
        seen += best > 0
    assert seen > 15


def test_notices_with_marks_between_and_very_many_license_words():
    known = [license_scan.Template(k, v, license_scan.IDENTITY.get(k, ()), 2.2) for k, v in license_scan.TEMPLATES.items()]
    vocabulary = {w for t in known for w in t.counts}
    marked = " ".join(f"{w} rem" for w in license_scan._MIT.split()).encode()
    assert license_scan.scan(marked, [license_scan.Template("MIT-permission", license_scan._MIT, (), 2.2)], vocabulary)[0][1] == 1.0
    narrow = [license_scan.Template(k, v, license_scan.IDENTITY.get(k, ())) for k, v in license_scan.TEMPLATES.items()]
    line = "this work is licensed under the gnu general public license version "
    began = time.process_time()
    assert license_scan.scan((line * 2000).encode(), narrow, vocabulary) == []
    assert len(license_scan.scan((line + "3 ").encode() * 2000, narrow, vocabulary)) == 2000
    assert time.process_time() - began < 30


def test_long_lines_without_spaces(spark):
    text = "x" * 60_000 + " Released under the MIT License. " + "y" * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.license_scan(docs).first()["license"] == "MIT"
    got = piece_sampling.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == 2 and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in got) and got[0]["ids"] != got[1]["ids"]
    packed = piece_sampling.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), packed=True).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in packed] == [r["ids"] for r in got]
