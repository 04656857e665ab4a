"""Quality scores from random Fourier features of document statistics.

A document is described by ``STATISTICS``, standardised over the training rows.  Random
Fourier features approximate a Gaussian kernel over them; a ridge regression on these
features is fitted from normal equations that each partition sums.  The sums are added up in
a tree, ``FAN_IN`` of them in a group, so no task and not the driver holds more than a few small matrices.
Isotonic regression on training rows that the ridge has not seen turns its output into
the probability of label 1.  It is fitted on counts in ``BINS`` bins of the score, whose
number does not grow with the data.

Statistics come from the text alone; ids, languages, sources and labels are no input.
Defined cases: a null text counts as empty, and empty texts get a score like any other;
a null label is no label; labels of unknown ids are ignored; an id that repeats is
scored on each row; with no label of either kind every score is the share of label 1 (or
0.5); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fold, stored, text_or_empty

STATISTICS = ("log_bytes", "letters", "capitals", "digits", "stops", "symbols", "bars", "bangs", "spaces", "lines", "word_length", "short_words", "distinct_words", "repeated_lines", "symbol_words", "capital_words", "commonest_word")
BINS, FAN_IN, LEVELS = 4096, 32, 3
THRESHOLD = 0.7


def _class_table() -> np.ndarray:
    """Byte by class: letters, capitals, digits, stops, symbols, bars, bangs, spaces, lines."""
    table = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        table[b] = [b > 127 or c.isalpha(), b < 128 and c.isupper(), c.isdigit() and b < 128, c in ".,;:'?-", b < 128 and c in "#$%&*@^~=+<>{}[]\\/_`\"()", c == "|", c == "!", c in " \t\r\v\f\n", c == "\n"]
    return table


CLASSES = _class_table()
SYMBOLS = frozenset(b"#$%&*@^~=+<>{}[]\\/_`|!")


def statistics(data: bytes) -> np.ndarray:
    """The values of ``STATISTICS`` for a text in UTF-8."""
    n = len(data)
    if not n:
        return np.zeros(len(STATISTICS))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES / n
    words = data.split()
    k = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    repeated = sum(map(len, lines)) - sum(map(len, set(lines)))
    symbols = sum(c for w, c in counts.items() if w[-1] in SYMBOLS)
    capitals = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    short = sum(c for w, c in counts.items() if len(w) < 4)
    return np.array([np.log1p(n), *shares, sum(map(len, words)) / k, short / k, np.log1p(len(counts)) / np.log1p(k), repeated / n, symbols / k, capitals / k, max(counts.values(), default=0) / k])


def text_statistics(text: Column) -> Column:
    """The statistics of each text; only texts go to Python, the rest of a row stays in the JVM."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        found = pa.array([statistics(x.as_buffer().to_pybytes()) for x in texts], pa.list_(pa.float64()))
        pa.default_memory_pool().release_unused()  # a worker goes on to other work
        return found

    return run(text_or_empty(text).cast("binary"))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, stats) of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), text_statistics(F.col(text_col)).alias("stats"))
    return rows.withColumnRenamed("_id", id_col)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([np.ones((len(z), 1)), z, waves], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.cuts, self.levels)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ``means`` of least weighted squares: pooled violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist(), strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.repeat([m for _, m, _ in blocks], [int(n) for _, _, n in blocks])


def fit(labelled: DataFrame, calibration: Column, features: int = 192, ridge: float = 1.0, width: float = 3.0, seed: int = 7) -> Model:
    """Fits on (stats, y) rows: the ridge where ``calibration`` is false, the isotonic part where it is true."""
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(1 + d + features), np.zeros(1), np.full(1, 0.5))
    train = labelled.where(~calibration)
    row = train.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row["n"]:
        return model
    model.mean = np.array([row[f"m{i}"] for i in range(d)])
    model.scale = np.maximum([row[f"s{i}"] for i in range(d)], 1e-3)
    size = 1 + d + features

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = model.features(matrix(batch.column(0)))
                total += x.T @ np.column_stack([x, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()])], names=["at", "part"])

    total = sum((np.frombuffer(r["part"]) for r in tree_sums(train.select("stats", "y").mapInArrow(partial, "at long, part binary")).collect()), np.zeros(size * (size + 1))).reshape(size, size + 1)
    penalty = np.full(size, ridge)
    penalty[0] = 1e-9
    model.weights = np.linalg.solve(total[:, :size] + np.diag(penalty), total[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor((model.raw(matrix(batch.column(0))) + 0.5) / 2 * (BINS - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    found = labelled.where(calibration).select("stats", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    if not found:
        model.cuts, model.levels = np.zeros(1), np.full(1, row["y"])
    else:
        bins, n, y = (np.array(c, float) for c in zip(*sorted((r["bin"], r["n"], r["y"]) for r in found), strict=True))
        model.cuts = (bins + 0.5) / (BINS - 1) * 2 - 0.5
        # half a row of each label, so that no score is certain
        prior = y.sum() / n.sum()
        fitted = isotonic(n, y / n)
        _, at = np.unique(fitted, return_inverse=True)
        block = np.bincount(at, n)[at]
        model.levels = np.maximum.accumulate((fitted * block + prior) / (block + 1))
    return model


def matrix(stats: pa.Array) -> np.ndarray:
    """An array of lists of equal length as a matrix."""
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)


def tree_sums(parts: DataFrame) -> DataFrame:
    """Sums of ``part`` (doubles as bytes) over groups of ``FAN_IN`` neighbours in ``at``, ``LEVELS`` times over."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in group["part"])
        return pa.table({"at": pa.array([group["at"][0].as_py() // FAN_IN], pa.int64()), "part": pa.array([total.tobytes()])})

    for _ in range(LEVELS):
        parts = parts.groupBy(F.floor(F.col("at") / FAN_IN)).applyInArrow(add, "at long, part binary")
    return parts


def score_of(model: Model) -> Callable[[Column], Column]:
    """The score of a column of statistics."""

    @F.arrow_udf("double")
    def run(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(stats)) if len(stats) else [], pa.float64())

    return run


def label_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id_col, y) of the labels that are not held out."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & (fold(F.col(id_col), 4) != 2))
    return known.groupBy(id_col).agg(F.max("y").alias("y"))


def fitted(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    """Fits on the labelled rows of (id_col, stats)."""
    return fit(stats.join(label_rows(labels, id_col, label_col), id_col), fold(F.col(id_col), 4) == 3)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted): learned from the labels of rows that are not held out."""
    stats = stored(document_statistics(docs, id_col, text_col), "quality-statistics")
    score = score_of(fitted(stats, labels, id_col, label_col))
    out = stats.select(id_col, score(F.col("stats")).alias("score"))
    return out.select(id_col, (fold(F.col(id_col), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good, each by its own text.

    Statistics are made again for the decision: so rows need no join by id, and no copy of the table is written.
    """
    stats = stored(document_statistics(docs, id_col, text_col), "quality-statistics")
    score = score_of(fitted(stats, labels, id_col, "quality"))
    drop_stored(stats)
    return docs.where(score(text_statistics(F.col(text_col))) >= THRESHOLD)
