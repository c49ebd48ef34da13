"""A quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of statistics of its whole text. The weights maximise the probability
that, of a good and a bad document, the good one scores higher: logistic loss on the feature differences of all
pairs of a good and a bad document, solved by Newton steps. The threshold is the quantile of the training scores at
the share of bad documents, and scores are mapped to 0 to 1 so that the threshold falls on 0.3.

Fitting takes every labelled document outside the held-out fold. A pair's loss depends on its two scores only, so
that a step is one aggregation over (class, range of scores): counts and moments of the ranges give the sums over all
pairs, to the second order of a range's width of 1 / BINS_PER_UNIT. The quantile is exact. Every document is scored. Labels, language, source and id are no features.

Defined cases: NULL texts score as empty ones; without pairs of both classes every score is 0.5; repeated
rows each get a row, and each takes part in fitting if its id is labelled; an empty table stays empty; further columns
are ignored by the query and kept by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FIT_ROWS, cut_lineage, digits, fold_of, held_out, running, set_aside, summed, training_labels
from .quality_rules import base_counts, word_hashes

#: Ranges of scores: up to BINS / 2 / BINS_PER_UNIT on either side of zero; what lies beyond is in the outermost.
BINS, BINS_PER_UNIT = 1024, 16
RIDGE = 1e-3
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
FEATURES = 16


def features(text: str | None) -> list[float]:
    """Statistics of a text, mostly roots of shares, so that differences are of like size."""
    raw = (text or "").encode()
    hashes = word_hashes(raw)
    if not len(hashes):
        return [0.0] * FEATURES
    n, chars, symbols, dup, repeated = base_counts(text, hashes)
    size = len(raw)
    amount = lambda chars: size - len(raw.translate(None, chars))
    lines = text.count("\n") + 1
    share = lambda x, y: (x / y) ** 0.5
    hashes.sort()
    distinct = 1 + int(np.count_nonzero(hashes[1:] != hashes[:-1]))
    upper, lower = amount(_UPPER), amount(_LOWER)
    return [
        1.0,
        np.log1p(n),
        chars / n,
        share(symbols, n),
        share(text.count("|"), n),
        share(raw.count(b"!"), n),
        share(raw.count(b".") + raw.count(b","), n),
        share(upper, upper + lower + 1),
        share(amount(_DIGIT), size),
        share(max(0, size - upper - lower - n), size),
        share(dup, lines),
        share(repeated, n),
        1.0 if 100 * repeated > 30 * n else 0.0,
        distinct / n,
        np.log1p(n / lines),
        share(sum(map(text.count, "#*$%&")), n),
    ]


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = self.raw(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(s + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _features_of(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, FEATURES)


def binned(x: np.ndarray, y: np.ndarray, model: Ranking) -> np.ndarray:
    """For each class and range of scores: rows, sum of scores, and first and second moments of the scaled features."""
    z, s = (x - model.mean) / model.scale, model.raw(x)
    at = np.clip(np.floor(s * BINS_PER_UNIT) + BINS // 2, 0, BINS - 1).astype(np.int64) + BINS * y.astype(np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
    values = np.column_stack([np.ones(len(s)), s, z, (z[:, :, None] * z[:, None, :]).reshape(len(s), -1)])[order]
    out = np.zeros((2 * BINS, values.shape[1]))
    out[at[order][starts]] = np.add.reduceat(values, starts)
    return out


def newton_step(table: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The step from ``w``, by the sums of ``binned``: gradient and curvature of the mean loss over all pairs."""
    n, m = (part[part[:, 0] > 0] for part in table.reshape(2, BINS, -1)[::-1])  # good, bad
    size, mean, first, second = zip(*[(c[:, 0], c[:, 1] / c[:, 0], c[:, 2 : 2 + len(w)], c[:, 2 + len(w) :].reshape(-1, len(w), len(w))) for c in (n, m)], strict=True)
    # within a range: variance of the scores, and what the scores around their mean add to the features
    spread = [np.maximum(x @ w @ w / k - s * s, 0) for k, s, x in zip(size, mean, second, strict=True)]
    lean = [x @ w - s[:, None] * f for s, f, x in zip(mean, first, second, strict=True)]
    p = 1 / (1 + np.exp(np.clip(mean[0][:, None] - mean[1][None, :], -30, 30)))  # probability of the wrong order
    h = p * (1 - p)
    p = p + h * (1 - 2 * p) * (spread[0][:, None] + spread[1][None, :]) / 2
    slope = (p @ size[1]) @ first[0] - (h @ size[1]) @ lean[0] - (size[0] @ p) @ first[1] - (size[0] @ h) @ lean[1]
    cross = first[0].T @ h @ first[1]
    own = np.tensordot(h @ size[1], second[0], 1) + np.tensordot(size[0] @ h, second[1], 1)
    pairs = size[0].sum() * size[1].sum()
    return np.linalg.solve((own - cross - cross.T) / pairs + RIDGE * np.eye(len(w)), slope / pairs - RIDGE * w)


def fit(rows: DataFrame) -> Ranking:
    """Rows (label, x), labels 0 or 1, to a ranking."""
    rows = cut_lineage(rows.select("label", "x"))
    bad, good = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not good or not bad:
        return Ranking(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(THRESHOLD / (1 - THRESHOLD))))
    rows = rows.coalesce((good + bad) // FIT_ROWS + 1)
    mean = digits(summed(rows, lambda b: _features_of(b).sum(0)) / (good + bad))
    scale = digits(np.sqrt(summed(rows, lambda b: ((_features_of(b) - mean) ** 2).sum(0)) / (good + bad)))
    scale[scale < 1e-9] = 1
    model = Ranking(mean, scale, np.zeros(FEATURES), 0.0)
    for _ in range(25):
        table = summed(rows, lambda b, now=model: binned(_features_of(b), b.column("label").to_numpy(), now))
        step = newton_step(table.reshape(2 * BINS, -1), model.weights)
        model = replace(model, weights=digits(model.weights + step))
        if np.abs(step).max() < 1e-6:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_features_of(b))), b.column("label")], names=["s", "y"])

    # the quantile at the share of bad documents, between two scores
    k = min(max(bad, 1), good + bad - 1)
    below = F.col("n_to") - F.col("n")
    sides = running(rows.mapInArrow(run, "s double, y int"), good + bad).agg(*[F.max(F.when(below <= i, F.col("s"))) for i in (k - 1, k)]).first()
    return replace(model, threshold=float(sum(sides) / 2))


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(texts[i].as_py()) for i in range(b.num_rows)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>")


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Texts are measured before they meet their labels, so that they never move."""
    return fit(with_features(docs.where(fold_of(F.col("doc_id")) != 0)).join(training_labels(labels, "quality"), "doc_id"))


def with_scores(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    rest = docs.drop("score", "predicted")
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(text)
            x = np.array([features(col[i].as_py()) for i in range(b.num_rows)], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x))], names=schema.names)

    return rest.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filter_documents(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns."""
    rows, names, back = set_aside(docs)
    return back(with_scores(rows, model, names["text"]).where("predicted = 1"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = cut_lineage(with_features(docs))
    model = fit(measured.join(training_labels(labels, "quality"), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(_features_of(b)))], names=["doc_id", "score"])

    scored = measured.mapInArrow(run, f"doc_id {dict(measured.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
