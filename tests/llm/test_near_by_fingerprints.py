"""Stage 4 takes what SimHash links as candidates, and verifies it."""

from pyspark.sql import functions as F

import corpus_pipeline
from eventide.llm import near_dedup


def test_fingerprints_offer_candidates(spark, monkeypatch):
    whole = near_dedup.candidates

    def none(texts):
        pairs, large = whole(texts)
        return near_dedup.stored(pairs.where(F.lit(False)), "none"), near_dedup.stored(large.where(F.lit(False)), "none")

    monkeypatch.setattr(near_dedup, "candidates", none)
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, text.replace(" ", "  ")), (4, "quite another text"), (None, text + " ")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == [1, 4]
