import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import quality_rff, toxicity


def test_isotonic():
    got = quality_rff.isotonic(np.ones(5), np.array([0.0, 1.0, 0.0, 0.5, 1.0]))
    assert got.tolist() == [0.0, 0.5, 0.5, 0.5, 1.0]
    rng = np.random.default_rng(1)
    w, y = rng.random(40), rng.random(40)
    fit = quality_rff.isotonic(w, y)
    assert (np.diff(fit) >= -1e-12).all() and (w * fit).sum() == pytest.approx((w * y).sum())


def corpus(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        toxic = i % 5 == 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(8, 60))]
        if toxic:
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(["grumpkin", "snorfwort", "snorfling"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    got = quality_rff.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got["predicted"] == got["quality"]).mean() > 0.97
    # held-out labels are no input: flipping them changes nothing
    flipped = labels.withColumn("quality", F.when(quality_rff.fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in quality_rff.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_edges(spark, odd, none):
    _, labels = corpus(spark, 60)
    messy = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (10**9, 0, 1)], labels.schema))
    got = quality_rff.quality_scores(odd, messy)
    assert got.count() == odd.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality_rff.quality_scores(none, messy).count() == 0
    assert quality_rff.quality_scores(odd, labels.where("false")).where("score = 0.5").count() == odd.count()
    assert quality_rff.accepted(odd, messy).columns == odd.columns


def test_toxicity(spark):
    docs, labels = corpus(spark)
    got = toxicity.toxicity(docs, labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert (got["toxic"] == got["label"]).mean() > 0.98
    assert got["severity"].between(0, 2).all() and (got["severity"] >= got["p_toxic"] - 1e-9).all()
    fresh = spark.createDataFrame([(9000, "alpha beta snorfzzz gamma"), (9001, "alpha beta gamma")], docs.schema)
    model = toxicity.fit(toxicity.training_sample(docs, labels, "doc_id", "text", "toxic"))
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.scored(fresh, model).collect()}
    assert p[9000] > 0.5 > p[9001]  # a stem of toxic words in a word that was never seen


def test_ordinal_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 300)
    rows = [[0] * 0 + ([0] if g > 0 else []) + ([1] if g > 1 else []) + [2] for g in grades]
    w, t = toxicity.fit_ordinal(rows, grades, 3)
    assert (np.diff(t) >= 0).all() and w[0] > 0 and w[1] > 0
    total = np.array([w[r].sum() for r in rows])
    assert ((total[:, None] > t).sum(axis=1) == grades).mean() > 0.95


def test_grades_come_from_labels(spark):
    docs, _ = corpus(spark, 6)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, 0, 1), (4, None, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic")
    assert {r["doc_id"]: r["y"] for r in sample.collect()} == {0: 0, 1: 0, 2: 2, 3: 1, 4: 2}


def test_ordinal_gradient_against_differences():
    """At the fit the penalised likelihood has no slope, taken by differences of its definition."""
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 120)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist() + ([6] if g else []))) for g in grades]
    w, t = toxicity.fit_ordinal(rows, grades, 7, l2=0.5, steps=4000)

    def loss(w, t):
        total = 0.25 * (w**2).sum()
        for r, g in zip(rows, grades, strict=True):
            over = [1.0, *(1 / (1 + np.exp(c - w[r].sum())) for c in t), 0.0]
            total -= np.log(over[g] - over[g + 1])
        return total

    for k in range(len(w) + len(t)):
        step = np.zeros(len(w) + len(t))
        step[k] = 1e-4
        slope = (loss(w + step[: len(w)], t + step[len(w) :]) - loss(w - step[: len(w)], t - step[len(w) :])) / 2e-4
        assert abs(slope) < 0.05, k


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d = len(quality_rff.STATISTICS)
    x = rng.normal(size=(6, d))
    model = quality_rff.Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / 3.0, (d, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    waves = model.features(x)[:, 1 + d :]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 3.0**2))
    assert np.abs(waves @ waves.T - kernel).max() < 0.05


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        w, y = rng.integers(1, 4, 5).astype(float), rng.integers(0, 5, 5) / 4
        fit = quality_rff.isotonic(w, y)
        # the max-min formula of the fit
        want = [max(min((w[a : b + 1] * y[a : b + 1]).sum() / w[a : b + 1].sum() for b in range(i, 5)) for a in range(i + 1)) for i in range(5)]
        assert fit.tolist() == pytest.approx(want)


def test_normal_equations_are_summed_whole(spark):
    parts = spark.range(3000).select(F.col("id").alias("at"), F.lit(np.array([1.0, 2.0]).tobytes()).alias("part"))
    got = quality_rff.tree_sums(parts).collect()
    assert len(got) == 1 and np.frombuffer(got[0]["part"]).tolist() == [3000.0, 6000.0]


def test_toxicity_edges(spark, odd, none):
    _, labels = corpus(spark, 60)
    messy = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    assert toxicity.toxicity(odd, messy).count() == odd.count()
    assert toxicity.toxicity(none, messy).count() == 0
    assert toxicity.toxicity(odd, labels.where("toxic = 0")).where("toxic = 1").count() == 0
    assert toxicity.accepted(odd, messy).columns == odd.columns


def test_one_row_for_each_sampled_id(spark):
    """A third of all rows repeat one labelled id: the driver gets one of them."""
    docs, labels = corpus(spark, 200)
    same = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("alpha snorfwort "), F.col("id").cast("string")).alias("text"))
    sample = toxicity.training_sample(docs.unionByName(same), labels, "doc_id", "text", "toxic")
    assert sample.count() == 200 and sample.select("doc_id").distinct().count() == 200


def test_severity_rises_with_the_grade(spark):
    """Toxic texts of bad quality, where fewer words offend, lie between clean and toxic ones on held-out ids."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30)]
        grade = i % 3
        for _ in range((0, 1, 5)[grade]):
            words[rng.randrange(30)] = rng.choice(["grumpkin", "snorfwort", "snorfling"])
        rows.append((i, " ".join(w + "!!" if grade == 1 else w for w in words)))
        labels.append((i, int(grade != 1), int(grade > 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_sample(docs, labels.where("doc_id % 5 <> 0"), "doc_id", "text", "toxic"))
    found = toxicity.scored(docs.where("doc_id % 5 = 0"), model).groupBy(F.col("doc_id") % 3).agg(F.avg("severity").alias("s"), F.avg((F.col("p_toxic") >= 0.5).cast("int")).alias("flagged")).collect()
    by = {r[0]: r for r in found}
    assert by[0]["s"] < by[1]["s"] < by[2]["s"] and by[2]["flagged"] >= by[1]["flagged"] > 0.9 > 0.1 > by[0]["flagged"]
