import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventide.llm import exact_dedup, near_dedup, simhash


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("digests", [True, False])
def test_exact(odd, digests):
    rows = [(r["doc_id"], norm(r["text"])) for r in odd.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    got = exact_dedup.duplicate_groups(odd, digests=digests).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(min((x for x in groups[t] if x is not None), default=None)), len(groups[t])) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_prefix_ties(spark):
    same = "p" * 400
    df = spark.createDataFrame([(1, same + "a"), (2, same + "b"), (3, same + "a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["text_sha256"] is not None) for r in exact_dedup.duplicate_groups(df).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, True)}


def test_exact_keeps_columns(odd, none):
    left = exact_dedup.without_duplicates(odd)
    assert left.columns == odd.columns
    texts = [norm(r["text"]) for r in left.where("doc_id is not null and doc_id <> 5").collect()]
    assert len(texts) == len(set(texts))
    assert exact_dedup.duplicate_groups(none, digests=True).count() == 0 == exact_dedup.without_duplicates(none).count()


def slow_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(fps, radius=3):
    """{fp: smallest linked fp} by comparing all."""
    out = {}
    for start in sorted(set(fps)):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            a = todo.pop()
            for b in set(fps):
                if b not in out and (a ^ b).bit_count() <= radius:
                    out[b] = start
                    todo.append(b)
    return out


def test_fingerprints(odd):
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1)) for r in simhash.fingerprints(odd).collect())
    assert got == sorted((str(r["doc_id"]), slow_simhash(r["text"])) for r in odd.collect())


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.append(x)
    fps = list(dict.fromkeys([*fps, *(rng.getrandbits(64) for _ in range(100)), 0, 7, 2**64 - 1]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    from eventide.operators.graph import components

    links = simhash.verified_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    got = {}
    for s, u in zip(signed, fps, strict=True):
        got.setdefault(roots.get(s, s), set()).add(u)
    want = {}
    for u, r in clusters(fps).items():
        want.setdefault(r, set()).add(u)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates(odd, none):
    rows = [(r["doc_id"], slow_simhash(r["text"])) for r in odd.collect()]
    root = clusters([f for _, f in rows])
    least = {}
    for i, f in rows:
        least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((str(i), str(least[root[f]])) for i, f in rows)
    assert simhash.representatives(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0


def test_large_group_of_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(base), F.lit(" tail"), F.col("id").cast("string")).alias("text"))
    kept = simhash.representatives(df).count()
    fps = [slow_simhash(r["text"]) for r in df.collect()]
    assert kept == len(set(clusters(fps).values()))


def slow_similarity(a, b, width=5):
    sets = []
    for t in (a, b):
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_with_edited_words(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for edits in (0, 1, 2, 4, 5, 9, 20):
            words = list(base)
            for at in rng.sample(range(300), edits):
                words[at] = f"new{g}x{edits}x{at}"
            texts.append(" ".join(words))
    # more copies than one bucket pairs off, null ids and an id that repeats with another text
    base = [f"v{i}" for i in range(200)]
    texts += [" ".join([*base[:i], f"edit{i}", *base[i + 1 :]]) for i in range(0, 200, 4)]
    ids = [None if i % 9 == 0 else 7 if i % 11 == 0 else i for i in range(len(texts))]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if slow_similarity(texts[i], texts[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in near_dedup.representatives(df).collect()]
    group = {t: r for t, r in zip(texts, root, strict=True)}
    assert sorted(group[t] for _, t in got) == sorted(set(root))
    for i, t in got:
        members = [x for x, r in zip(ids, root, strict=True) if r == group[t] and x is not None]
        assert i == min(members, default=None)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Chains in which only neighbours are alike, with one hub for each bucket of three rows or more, and small tiles."""
    for name, value in (("SMALL", 2), ("FLIPS", (0,)), ("TILE", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(8)
    texts = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(200)]
        for step in range(40):
            texts.append(" ".join(words))
            for at in rng.sample(range(200), 3):
                words[at] = f"g{g}s{step}x{at}"
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if slow_similarity(texts[i], texts[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(r["doc_id"] for r in near_dedup.representatives(df).collect())
    assert got == sorted({min(i for i, r in enumerate(root) if r == g) for g in root})


def test_tile_links_by_definition():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 20).astype(np.uint64)) for _ in range(40)]
    tile = near_dedup.Tile(0.5)
    for k, s in enumerate(sets[:20]):
        tile.add(k, s)
    got = [pair for k, s in enumerate(sets[20:], 20) for pair in tile.links(k, s)]
    want = [(a, b) for a in range(20, 40) for b in range(20) if near_dedup.similarity(sets[a], sets[b]) >= 0.5]
    assert set(got) <= set(want) and want
    groups = lambda pairs: {frozenset(g) for g in near_groups(range(40), pairs)}
    assert groups(got) == groups(want)


def near_groups(nodes, pairs):
    root = {n: n for n in nodes}
    for a, b in pairs:
        x, y = root[a], root[b]
        root = {n: x if r == y else r for n, r in root.items()}
    return [[n for n in nodes if root[n] == r] for r in set(root.values())]


def test_near_defined_cases(odd, none):
    kept = near_dedup.representatives(odd)
    assert kept.columns == odd.columns and near_dedup.representatives(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 3, 4, 7, 8, 9, 10, 11, 12]))


def test_hot_keys_are_dealt_apart(spark, monkeypatch):
    """A third of the rows under one key, with joins that broadcast hardly anything: the same results."""
    from eventide.operators import skew

    docs = spark.createDataFrame([(i, "the same text for many rows of it" if i % 3 == 0 else f"text {i} of {i * 7} words that {i % 5} are its own {i * i}") for i in range(600)], "doc_id long, text string").repartition(6)
    plain = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = {r["doc_id"] for r in near_dedup.representatives(docs).collect()}
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 20)
    monkeypatch.setattr(skew, "SALTS", 4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == plain
    assert {r["doc_id"] for r in near_dedup.representatives(docs).collect()} == kept
    assert {d for d in kept if d % 3 == 0} == {0}
