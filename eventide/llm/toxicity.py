"""Toxicity grades by a cumulative-link (proportional odds) model on sparse text features.

Severity has ordered grades 0, 1, ..., G.  One weight per feature is shared by all
thresholds: P(grade > g) = logistic(w.x - t_g) with t_0 <= t_1 <= ..., and the expected
severity is the sum of these.  Features are the words of a text, letters lower-cased,
and the beginnings of ``STEMS`` characters of longer words, each present or not.

Grades come from the labels alone: 0 for a clean text, 1 for a toxic one that is also labelled as of bad quality, 2 for any other toxic one.
This order is the one that held-out texts bear out (figures in the README): of a toxic text that has become junk, little that offends can still be
read.  Labels without a quality have two grades, clean and toxic.  With labels that have grades already, pass them as they are.
Candidates are features that toxic texts have more often; their weights may have either sign.  (Features of
clean texts as candidates too made held-out recall worse, see the README.)

Training reads a bounded sample: ``SAMPLE`` labelled rows at most, the ones with the
smallest hash of their id and one for each id (that with the least text), and ``FEATURES`` features at most, those most telling.  All
rows are scored on whole texts.  Defined cases: a null text counts as empty; a null label is no label;
rows that repeat an id are scored each; an empty text has no features; without toxic or without clean
labels every row has severity 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SAMPLE, FEATURES, CACHE_WORDS = 30_000, 20_000, 150_000
STEMS = (4, 5, 6)
THRESHOLD = 0.5
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"


def word_features(word: str) -> list[str]:
    """The features of one word."""
    word = word.strip(STRIP).lower()
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)] if word else []


def features(data: bytes) -> set[str]:
    """The features of a text in UTF-8."""
    return {f for w in set(data.split()) for f in word_features(w.decode(errors="replace"))}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.array([50.0]))

    def expected(self, total: float) -> tuple[float, float]:
        """P(grade > 0) and the expected grade for a sum of weights."""
        over = 1 / (1 + np.exp(np.clip(self.thresholds - total, -500, 500)))
        return float(over[0]), float(over.sum())


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, width: int, l2: float = 0.02, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model, by accelerated gradient steps on the likelihood.

    Thresholds are t_0 and the logarithms of the gaps to the next ones, so they stay ordered.
    """
    levels = int(grades.max())  # grades without rows get no threshold of their own: see ``fit``
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(at))
    w, t = np.zeros(width), np.concatenate([[1.0], np.zeros(levels - 1)])
    velocity, square = np.zeros(width + levels), np.zeros(width + levels)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        total = np.bincount(at, w[col], len(rows))
        upper = np.concatenate([np.full((len(rows), 1), 1.0), 1 / (1 + np.exp(np.clip(cuts - total[:, None], -500, 500))), np.zeros((len(rows), 1))], axis=1)
        slope = upper * (1 - upper)
        k = grades.astype(int)
        i = np.arange(len(rows))
        p = np.maximum(upper[i, k] - upper[i, k + 1], 1e-12)
        by_total = -(slope[i, k] - slope[i, k + 1]) / p
        by_cut = np.zeros(levels)
        np.add.at(by_cut, np.clip(k - 1, 0, None), np.where(k > 0, slope[i, k] / p, 0))
        np.add.at(by_cut, np.clip(k, None, levels - 1), np.where(k < levels, -slope[i, k + 1] / p, 0))
        tail = np.cumsum(by_cut[::-1])[::-1]
        by_t = np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])
        gradient = np.concatenate([np.bincount(col, by_total[at], width) + l2 * w, by_t])
        velocity = 0.9 * velocity + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.1 * (1 - (step - 1) / steps) * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:width], t - move[width:]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, quality_col: str = "quality") -> DataFrame:
    """(id, data, y): at most ``SAMPLE`` rows, one for each id, y being the grade; the ids are broadcast, being so few.

    A toxic text whose ``quality_col`` is 0 is graded 1, any other toxic one 2.
    """
    y = F.col(label_col).cast("int")
    if quality_col in labels.columns:
        y = F.when((y == 1) & ~F.coalesce(F.col(quality_col) == 0, F.lit(False)), 2).otherwise(y)
    marked = labels.select(F.col(id_col), y.alias("y")).where(F.col("y").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64(F.lit(4), id_col), id_col).limit(SAMPLE)
    rows = docs.select(id_col, text_or_empty(text_col).cast("binary").alias("data")).join(F.broadcast(chosen), id_col)
    # an id may stand in any number of rows
    return rows.groupBy(id_col).agg(F.min("data").alias("data"), F.min("y").alias("y"))


def fit(sample: DataFrame) -> Model:
    """Fits on (data, y), y being the grade.

    Features are counted in Spark; the driver gets the most telling ones and, of each
    sampled row, only which of them it has.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for data, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (bad if y else good).update(features(data.as_buffer().to_pybytes()))
        names = list(bad)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()), pa.array([good[f] for f in names], pa.int64())], names=["feature", "bad", "good"])
        # features of clean rows alone are never chosen, but those that another task has met in toxic rows need their count
        rest = [f for f in good if f not in bad]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([good[f] for f in rest], pa.int64())], names=["feature", "bad", "good"])

    totals = {r["y"]: r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = totals.get(True, 0), totals.get(False, 0)
    if not n_bad or not n_good:
        return Model()
    counts = sample.select("data", "y").mapInArrow(counted, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 2")
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    telling = counts.withColumn("odds", odds).where("odds > 1.5").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "feature").limit(FEATURES).collect()
    index = {r["feature"]: i for i, r in enumerate(telling)}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [sorted(index[f] for f in features(data.as_buffer().to_pybytes()) if f in index) for data in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cols, pa.list_(pa.int32()))], names=["y", "cols"])

    rows = sample.select("data", "y").mapInArrow(encoded, "y int, cols array<int>").collect()
    # grades that occur, in order, are counted through: without toxic texts of bad quality there are two
    grades = np.unique([r["y"] for r in rows], return_inverse=True)[1]
    w, thresholds = fit_ordinal([list(r["cols"]) for r in rows], grades, max(1, len(index)))
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, thresholds)


def severity_of(model: Model) -> Callable[[Column], Column]:
    """(p_toxic, severity) of a column of texts in UTF-8; only texts go to Python, the rest of a row stays in the JVM."""
    weights = model.weights
    known: dict[bytes, tuple] = {}

    @F.arrow_udf("struct<p_toxic:double,severity:double>")
    def run(texts: pa.Array) -> pa.Array:
        p, severity = [], []
        for data in texts:
            words = set(data.as_buffer().to_pybytes().split())
            new = [w for w in words if w not in known]
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(words)
            known.update((w, tuple(f for f in word_features(w.decode(errors="replace")) if f in weights)) for w in new)
            present = {f for w in words for f in known[w]}
            a, b = model.expected(sum(weights[f] for f in sorted(present)))
            p.append(a)
            severity.append(b)
        pa.default_memory_pool().release_unused()  # a worker goes on to other work
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(severity, pa.float64())], names=["p_toxic", "severity"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_toxic, severity) of each row."""
    found = docs.select(F.col(id_col).alias("_id"), severity_of(model)(text_or_empty(text_col).cast("binary")).alias("_s"))
    return found.select(F.col("_id").alias(id_col), "_s.p_toxic", "_s.severity")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, p_toxic, severity, toxic): learned from a bounded sample of the labels."""
    model = fit(training_sample(docs, labels, id_col, text_col, label_col))
    return scored(docs, model, id_col, text_col).withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic, each by its own text."""
    model = fit(training_sample(docs, labels, id_col, text_col, "toxic"))
    score = severity_of(model)
    return docs.where(score(text_or_empty(text_col).cast("binary"))["p_toxic"] < THRESHOLD)
