import os
import random
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eventide.llm import exact_dedup, quality_rff, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0.5 * rows < docs.count() <= rows, name
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == rows
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), SF).count() == 0


def test_rows_are_judged_one_by_one(spark):
    good = [f"Some plain sentences about topic {i} and {i * 7}, which a reader may follow with ease." for i in range(60)]
    bad = [f"vile scum {i} filth idiot {i * 3}" for i in range(60)]
    texts = [*good, *bad]
    rows = [(i, t) for i, t in enumerate(texts)]
    # null ids, an id that repeats with another text, and copies with the keeper's id
    rows += [(None, bad[0] + " again"), (None, good[0] + " again"), (0, bad[1] + " more"), (1, good[1]), (None, good[2]), (None, "null twin"), (None, "null twin")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    key = lambda r: (str(r["doc_id"]), r["text"])
    tox = toxicity.fit(toxicity.training_sample(docs, labels, "doc_id", "text", "toxic"))
    over = {r["text"]: r["p_toxic"] for r in toxicity.scored(docs, tox, "text").collect()}
    assert sorted(map(key, toxicity.accepted(docs, labels).collect())) == sorted((str(i), t) for i, t in rows if over[t] < 0.5)
    assert over[bad[0] + " again"] >= 0.5 > over[good[0]]
    scores = {t: s for t, s in quality_by_text(docs, labels)}
    assert sorted(map(key, quality_rff.accepted(docs, labels).collect())) == sorted((str(i), t) for i, t in rows if scores[t] >= 0.7)
    for dedup in (exact_dedup.without_duplicates, simhash.representatives):
        kept = [key(r) for r in dedup(docs).collect()]
        assert len({t for _, t in kept}) == len(kept) and sum(t == "null twin" for _, t in kept) == 1, dedup
    kept = sorted(key(r) for r in exact_dedup.without_duplicates(docs).collect())
    assert kept == sorted((str(min((i for i, u in rows if u == t and i is not None), default=None)), t) for t in {t for _, t in rows})


def quality_by_text(docs, labels):
    model = quality_rff.fitted(quality_rff.document_statistics(docs), labels, "doc_id", "quality")
    return [(r["text"], float(model.score(quality_rff.statistics((r["text"]).encode())[None])[0])) for r in docs.collect()]


def test_run_is_the_stages_by_hand(spark, tmp_path):
    """The whole pipeline against plain Python; only the two models' weights are taken from the operators."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows, marks = [], []
    for i in range(240):
        kind = i % 6
        text = sentence(rng.randrange(20, 90))
        if kind == 1:
            text = text.upper().replace(" ", " !! ")
        elif kind == 2:
            text += " you vile scum, filth and idiot."
        elif kind == 3 and i > 20:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 4:
            near = rows[i - 4][1].split(" ")
            near[len(near) // 2] = f"edit{i}"
            text = " ".join(near)
        rows.append((None if i % 29 == 0 else i, text))
        marks.append((i, int(kind != 1), int(kind == 2)))
    rows += [(5, rows[7][1]), (None, rows[0][1]), (1000, None), (1001, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    quality = quality_rff.fitted(quality_rff.document_statistics(docs), labels, "doc_id", "quality")
    kept = [(i, t) for i, t in rows if quality.score(quality_rff.statistics((t or "").encode())[None])[0] >= 0.7]
    left = spark.createDataFrame(kept, "doc_id long, text string")
    tox = toxicity.fit(toxicity.training_sample(left, labels, "doc_id", "text", "toxic"))
    total = lambda t: sum(tox.weights[f] for f in sorted(toxicity.features((t or "").encode())) if f in tox.weights)
    clean = [(i, t) for i, t in kept if tox.expected(total(t))[0] < 0.5]
    assert len(rows) > len(kept) > len(clean) > 60
    order = lambda i: (i is None, i)
    firsts = {}
    for i, t in sorted(clean, key=lambda r: order(r[0])):
        firsts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), (i, t))
    alone = list(firsts.values())
    sets = []
    for _, t in alone:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(alone)))
    for a in range(len(alone)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    survivors = [min((alone[k] for k, g in enumerate(group) if g == own), key=lambda r: order(r[0])) for own in set(group)]
    assert len(survivors) < len(alone) < len(clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in survivors)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in out if r["start"] == 0) == want
    assert sum(r["length"] for r in out) == sum(n for _, n in want)


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
