"""Confidences and rates that are ties at their last digit, and nulls, come out of calibration as in the SQL."""

import random

import duckdb
import pytest

from eventide.plans import catalogue


@pytest.fixture(scope="module", params=[False, True], ids=["ties", "nulls"])
def reviewed(spark, tmp_path_factory, request):
    """Documents whose lengths are ties at the fourth digit of a confidence, of all languages but one; better ones are longer."""
    sf = str(tmp_path_factory.mktemp("reviewed"))
    r = random.Random(4)
    docs, labels = [], []
    for i in range(6000):
        lang = r.choice(["en", "fr", "de", "es", None if request.param else "pl"])
        good = r.random() < 0.5
        n = None if request.param and r.random() < 0.02 else 2 * r.randrange(100, 160 if lang == "en" else 1500) + 1 + 40 * good
        docs.append((i, "", lang, "web", n))
        labels.append((i, int(good), 0))
    # the rank sum of this type is a tie at the third digit: 500.5 of 1,000 pairs
    lengths = [2002, *[2000] * 499, 2002, *[2004] * 500]
    docs += [(10000 + i, "", "it", "web", n) for i, n in enumerate(lengths)]
    labels += [(10000 + i, min(i, 1), 0) for i in range(len(lengths))]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    return sf, con


@pytest.mark.parametrize("name", ["q_auc", "q_best_cut", "q_threshold_proposal"])
def test_calibration(spark, reviewed, name):
    sf, con = reviewed
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLE_SQL[name])
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
