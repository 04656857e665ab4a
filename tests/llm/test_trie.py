"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from eventide.llm import prefix_trie as pt
from eventide.operators import skew


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plainly(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, found = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        end = ",".join(str(c) for c in sorted(nodes[p]) if len(whole[c]) == len(p))
        found.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(found, key=str)


def trie(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("name", "node", "i", "depth", "digest", "rank")})
    return sorted((tuple(r) for r in pt.prefix_trie(table.repartition(3)).collect()), key=str)


def made(seed, n, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, n):
        if rng.random() < 0.9:
            rows += [(c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(words)) for k in range(rng.randint(0, longest))]
    return rows


def test_nodes_with_nulls_ties_and_repeats(spark):
    rows = made(1, 60, 12, ["a", "é𐍈", "", None]) + [(None, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "user", "b")]
    assert trie(spark, rows) == plainly(rows)


def test_a_long_conversation_and_its_copies(spark):
    long = [(k, "user", f"turn {k % 3}") for k in range(700)]
    rows = [(c, *x) for c in (0, 1, 2, 40, 41) for x in long] + [(41, 9999, "user", "more")] + made(2, 50, 3, ["a", "b"])
    assert trie(spark, rows) == plainly(rows)


def test_one_conversation_a_third_of_all_and_joins_beyond_broadcasting(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_KEYS", 20)
    monkeypatch.setattr(pt, "STRETCH", 4)
    rows = [(c, k, "user", f"same {k}") for c in range(100) for k in range(5)] + made(3, 150, 6, ["same 0", "same 1", "x"])
    assert trie(spark, rows) == plainly(rows)


def test_empty_and_turnless(spark):
    assert trie(spark, []) == []
    few = [(c, 0, "user", "a") for c in range(1, 5)]
    assert trie(spark, few) == plainly(few)
